"""Language identification with bit-sliced Bloom filters.

One matrix row holds, as a bit mask over languages, the same cell of every
language's Bloom filter; the AND of an n-gram's rows names all languages that
contain it. A document's n-grams are popcounted per language, the expected
false positives are taken off, and the largest share decides.

Fitting uses a bounded sample: about ``docs_per_lang`` labelled documents of
each language, chosen by a hash of the document id, and the ``grams_per_lang``
most frequent n-grams of each. Every label is learned: languages go by
``slice_langs`` to a slice, whose matrix is a file in the shared folder that
workers map, so memory and what is sent to tasks don't grow with their number;
the driver holds a name for each.

Defined cases: a text that is null or has no letter is ``und`` with score 0,
as is every text if nothing was learned. Equal shares go to the language with
more labelled documents, then to the smaller name. Rows that repeat are judged
alike; an empty table gives no rows. Columns of the results' names are
replaced; others are carried as they are.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, discard, local_path, settle, shared_folder, small_batches, write_file
from .textkit import chunks, release, text_buffer

GRAM = 4
_C = tuple(np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


@dataclass
class LangModel:
    """langs: most frequent label first; slices: the files of the matrices, each of slice_langs languages but the last; fpr: of each language."""

    langs: list[str]
    bits: int
    hashes: int
    slice_langs: int
    slices: list[str]
    fpr: np.ndarray

    def planes(self, k: int) -> np.ndarray:
        """(2**bits, words): the bits of slice k's languages."""
        kind = _mask_type(min(self.slice_langs, len(self.langs) - k * self.slice_langs))
        return _mapped(self.slices[k], kind.str, self.bits)


def _mask_type(n: int) -> np.dtype:
    return np.dtype(next((t for t, width in (("u1", 8), ("u2", 16), ("u4", 32)) if n <= width), "u8"))


@lru_cache(maxsize=256)
def _mapped(path: str, kind: str, bits: int) -> np.ndarray:
    return np.memmap(path, kind, "r").reshape(1 << bits, -1)


def _cells(g: np.ndarray, k: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((g + np.uint64(1)) * _C[k]) >> np.uint64(64 - bits)


def _prepare(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower case with ASCII non-letters as spaces, one space before and two after."""
    low = pc.utf8_lower(pc.fill_null(col, ""))
    data, offs = text_buffer(pc.binary_join_element_wise(pa.scalar(" ", low.type), low, pa.scalar("  ", low.type), pa.scalar("", low.type)))
    return _KEEP[data], offs


_KEEP = np.arange(256, dtype=np.uint8)
_KEEP[[b for b in range(128) if not 97 <= b <= 122]] = 32


def _grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """n-grams and the mask of those inside a document that aren't mere spaces."""
    d = data.astype(np.uint32)
    g = (d[:-3] << 24) | (d[1:-2] << 16) | (d[2:-1] << 8) | d[3:]
    ok = g != 0x20202020
    for k in range(1, GRAM):
        at = offs[1:-1] - offs[0] - k
        ok[at[(at >= 0) & (at < len(g))]] = False
    return g, ok


def fit(labelled: DataFrame, docs_per_lang: int = 3000, grams_per_lang: int = 30_000, slice_langs: int = 64, bits: int = 20, hashes: int = 2) -> LangModel:
    """labelled: doc_id, text, lang; rows with a null text or lang are left out."""
    spark = labelled.sparkSession
    rows = labelled.select("doc_id", "text", "lang").filter("text is not null and lang is not null")
    sizes = settle(rows.groupBy("lang").agg(F.count("*").alias("n")), "labels")
    langs = [r["lang"] for r in sizes.orderBy(F.desc("n"), "lang").select("lang").collect()]
    if not langs:
        return LangModel([], bits, hashes, slice_langs, [], np.zeros(0))
    unit = (F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 30) - 1))) / F.lit(float(1 << 30))
    sample = rows.join(sizes, "lang").filter(unit * F.col("n") < docs_per_lang).select("lang", "text")

    def count(batches):
        for batch in batches:
            names = batch.column(0).to_numpy(zero_copy_only=False)
            data, offs = _prepare(batch.column(1))
            for i, j in chunks(offs):
                part = data[offs[i] : offs[j]]
                if len(part) < GRAM:
                    continue
                g, ok = _grams(part, offs[i : j + 1])
                doc = np.repeat(np.arange(i, j), np.diff(offs[i : j + 1]))[: len(g)]
                for name in set(names[i:j]):
                    u, n = np.unique(g[ok & (names[doc] == name)], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(u), pa.string()), pa.array(u.astype(np.int64)), pa.array(n.astype(np.int64))], names=["lang", "gram", "n"])

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = settle(counted.withColumn("r", rank).filter(F.col("r") <= grams_per_lang).select("lang", "gram"), "grams")
    model = LangModel(langs, bits, hashes, slice_langs, [], np.zeros(len(langs)))
    folder = local_path(shared_folder(spark))
    for lo in range(0, len(langs), slice_langs):
        own = langs[lo : lo + slice_langs]
        kind = _mask_type(len(own))
        width = 8 * kind.itemsize
        planes = np.zeros((1 << bits, -(-len(own) // width)), kind)
        held = top.filter(F.col("lang").isin(own)) if len(langs) > slice_langs else top  # grams_per_lang rows a language
        held = held.toArrow()
        number = pc.index_in(held.column("lang"), pa.array(own)).to_numpy()
        grams = held.column("gram").to_numpy().astype(np.uint64)
        for x in range(len(own)):
            g = grams[number == x]
            for k in range(hashes):
                planes[_cells(g, k, bits), x // width] |= kind.type(1 << (x % width))
            model.fpr[lo + x] = (((planes[:, x // width] >> kind.type(x % width)) & kind.type(1)).mean()) ** hashes
        path = f"{folder}/slice-{lo}"
        write_file(path, planes.tobytes())
        model.slices.append(path)
    discard(sizes, top)
    return model


def _best(model: LangModel, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's language (its number) of the largest share of n-grams, corrected for false positives, and that share: slice by slice, a tie to the earlier language."""
    n = len(offs) - 1
    win, share = np.zeros(n, np.int64), np.full(n, -1.0)
    if len(data) < GRAM:
        return win, np.zeros(n)
    g, ok = _grams(data, offs)
    g = g[ok].astype(np.uint64)
    doc = np.repeat(np.arange(n), np.diff(offs))[: len(ok)][ok]
    cells = [_cells(g, k, model.bits) for k in range(model.hashes)]
    total = np.maximum(np.bincount(doc, minlength=n), 1)
    for k in range(len(model.slices)):
        planes = model.planes(k)
        mask = planes[cells[0]]
        for c in cells[1:]:
            mask &= planes[c]
        width = 8 * mask.dtype.itemsize
        lo = k * model.slice_langs
        for x in range(lo, min(lo + model.slice_langs, len(model.langs))):
            word, place = divmod(x - lo, width)
            bit = (mask[:, word] >> mask.dtype.type(place)) & mask.dtype.type(1)
            # bits are counted for one language at a time: a document's n-grams stand together
            hits = np.bincount(doc, bit, n) / total
            s = np.clip((hits - model.fpr[x]) / max(1e-9, 1 - model.fpr[x]), 0, 1)
            better = s > share
            win[better], share[better] = x, s[better]
    return win, np.maximum(share, 0)


def predict(docs: DataFrame, model: LangModel, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of docs and, under names, the language (string) and the winner's share (double).

    Only texts go to Python, once and in one direction; the other columns stay where they are.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, share: double>")
    def judged(col: pa.Array) -> pa.Array:
        import regex

        m = shared.value
        data, offs = _prepare(col)
        letter = regex.compile(r"\p{L}")
        known = [bool(m.langs) and x.is_valid and letter.search(x.as_py()) is not None for x in col]
        langs, best = [], []
        for i, j in chunks(offs):
            win, share = _best(m, data[offs[i] : offs[j]], offs[i : j + 1])
            for k in range(j - i):
                langs.append(m.langs[win[k]] if known[i + k] else "und")
                best.append(float(share[k]) if known[i + k] else 0.0)
        del data
        release()
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(best, pa.float64())], ["lang", "share"])

    own = [column(c) for c in docs.columns if c not in names]
    made = "__judged"
    while made in docs.columns:
        made += "_"
    held = docs.select(*own, judged(column(text)).alias(made))
    return held.select(*own, *[F.col(made).getField(f).alias(name) for f, name in zip(("lang", "share"), names)])
