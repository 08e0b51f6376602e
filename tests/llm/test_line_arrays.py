"""Lines of a buffer against plain Python: places, judged lines, hashes of any code points."""

import numpy as np
import pyarrow as pa

from fathom.llm.lines import LineRules, Lines
from fathom.llm.textkit import U64, mix64, powers, text_buffer

TEXTS = ["", "a\n\n  \t\nb c\x0b\r", "é\n\U0001f600 ü￿\n" + " " * 25, None, "\n", "x" * 40 + "\n" + "\U0001f600\U0010ffff" * 3, "\x0e\x08 \x1f", "ä\U0001f600"]


def test_lines_as_plain():
    rules = LineRules()
    data, offs = text_buffer(pa.array(["skipped ö\n", *TEXTS, "end"]))
    ls = Lines(data, offs, 1, len(TEXTS) + 1, rules)
    want = []
    for d, text in enumerate(TEXTS, 1):
        for place, line in enumerate((text or "").split("\n")):
            if len(line) >= rules.min_chars and (any(c not in " \t\n\x0b\x0c\r" for c in line) or len(line) >= 20):
                want.append((d, place, line))
    assert list(zip(ls.doc.tolist(), ls.place.tolist(), [ls.text(k) for k in range(len(ls.doc))])) == want
    up, _ = powers(64)
    with np.errstate(over="ignore"):
        for h, (*_, line) in zip(ls.hash, want):
            points = np.array([ord(c) for c in line], U64)
            plain = (mix64(points + U64(1)) * up[: len(points)]).sum(dtype=U64) + U64(len(points)) * U64(0xD6E8FEB86659FD93)
            assert h == mix64(np.array([plain]))[0]
