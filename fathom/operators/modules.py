"""Modules: what an import names, where a re-exported name is declared, and which parameter an argument meets.

Null paths, names and specifiers are no rows; repeated rows count once; empty
tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.addresses import normalized_path
from ..plans.lineage import cut

#: Extensions tried, in order, and what stands in for an extension that a specifier names. Fixed values.
EXTENSIONS = ("ts", "tsx", "d.ts", "js", "jsx")
STAND_INS = (("js", ("ts", "tsx", "d.ts")), ("jsx", ("tsx", "d.ts")))


def answers(files: DataFrame) -> DataFrame:
    """(stem, target): the file of files (path) that each stem resolves to.

    In order: the stem with an extension, an extension in place of a script's,
    the file itself, the folder's index. A stem that ends in / is a folder. The
    files answer, some six stems each, so that an import is one look-up however
    many places are tried for it.
    """
    path = F.col("path")
    tried = []

    def stem(end: str, instead: str) -> None:
        hit = path.endswith(end)
        tried.append(F.when(hit, F.struct(F.concat(path.substr(F.lit(1), F.length(path) - len(end)), F.lit(instead)).alias("stem"), F.lit(len(tried)).alias("rank"))))

    for e in EXTENSIONS:
        stem(f".{e}", "")
    for script, others in STAND_INS:
        for e in others:
            stem(f".{e}", f".{script}")
    stem("", "")
    for e in EXTENSIONS:
        stem(f"/index.{e}", "")
        stem(f"/index.{e}", "/")
    each = F.explode(F.filter(F.array(*tried), lambda s: s.isNotNull())).alias("s")
    return files.filter("path is not null").select("path", each).groupBy("s.stem").agg(F.min_by("path", F.struct("s.rank", "path")).alias("target"))


def wanted(file_path: Column, specifier: Column) -> Column:
    """The stem that a relative specifier asks for; null for one that isn't relative or leaves the root."""
    relative = specifier.rlike(r"^\.\.?(/|$)")
    place = normalized_path(F.concat(F.regexp_replace(file_path, "[^/]*$", ""), specifier))
    return F.when(relative, F.concat(place, F.when(specifier.rlike(r"(^|/)\.{0,2}$"), F.lit("/")).otherwise(F.lit(""))))


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """imports (file_path, line, specifier) with target, the file they name; null for another module's."""
    i = imports.select("file_path", "line", "specifier").filter("file_path is not null and specifier is not null").distinct()
    i = i.withColumn("stem", wanted(F.col("file_path"), F.col("specifier")))
    # rows without a stem don't meet the files: nulls would all go to one task
    # merged, as the stems grow with the files: from the size of a stored file Spark takes several times as many stems for few, and broadcasts them by way of the driver
    local = i.filter("stem is not null").join(answers(files).hint("merge"), "stem", "left")
    return local.unionByName(i.filter("stem is null").withColumn("target", F.lit(None).cast("string"))).drop("stem")


def import_edges(resolved: DataFrame) -> DataFrame:
    """(id, kind, from_id, to_id, specifier): an edge from file to file or external module, once, with its first specifier by line."""
    file_id = lambda c: F.concat_ws(":", F.lit("file"), c, c, F.lit("0"))
    to = F.when(F.col("target").isNotNull(), file_id(F.col("target"))).otherwise(F.concat(F.lit("external_module:~:"), "other"))
    # ids, which are several times as long, are made of what is left; a file's few imports are sorted where they meet, once
    ends = resolved.select("file_path", "target", F.when(F.col("target").isNull(), F.col("specifier")).alias("other"), "line", "specifier").repartition("file_path")
    e = ends.groupBy("file_path", "target", "other").agg(F.min(F.struct("line", "specifier")).alias("first"))
    e = e.select(file_id(F.col("file_path")).alias("from_id"), to.alias("to_id"), "first")
    return e.select(F.concat(F.lit("IMPORTS:"), "from_id", F.lit("=>"), "to_id").alias("id"), F.lit("IMPORTS").alias("kind"), "from_id", "to_id", F.col("first.specifier").alias("specifier"))


def external_modules(resolved: DataFrame) -> DataFrame:
    """(id, kind, file_path, name, line): a synthetic node for each module that isn't a file."""
    m = resolved.filter("target is null").select(F.col("specifier").alias("name")).distinct()
    return m.select(F.concat(F.lit("external_module:~:"), "name").alias("id"), F.lit("external_module").alias("kind"), F.lit("").alias("file_path"), "name", F.lit(0).alias("line"))


def declared_at(declarations: DataFrame, reexports: DataFrame) -> DataFrame:
    """Each exported name's declaration: (module, name, at_module, at_name, state).

    declarations (module, name) and reexports (module, name, to_module,
    to_name); a declaration goes before a re-export of its name, of several
    re-exports the smallest counts. State is declared, missing (a chain ends at
    a name that nobody exports) or cycle; the last two have a null place.

    Pointers jump: each round, an open name points where its pointer points, so
    rounds grow with the logarithm of the longest chain. A round that settles
    none has only cycles before it: were a name n steps from its end, another
    would be n - 1 steps from it.
    """
    own = declarations.select("module", "name").filter("module is not null and name is not null").distinct()
    own = own.select("module", "name", F.col("module").alias("to_module"), F.col("name").alias("to_name"), F.lit("declared").alias("state"))
    via = reexports.filter("module is not null and name is not null and to_module is not null and to_name is not null")
    via = via.groupBy("module", "name").agg(F.min(F.struct("to_module", "to_name")).alias("to"))
    via = via.join(own.select("module", "name"), ["module", "name"], "left_anti").select("module", "name", "to.to_module", "to.to_name", F.lit("open").alias("state"))
    names = cut(own.unionByName(via))
    left = names.filter("state = 'open'").count()
    while left:
        ahead = names.select(F.col("module").alias("to_module"), F.col("name").alias("to_name"), F.struct(F.col("to_module").alias("m"), F.col("to_name").alias("n"), F.col("state").alias("s")).alias("next"))
        jumped = names.filter("state = 'open'").join(ahead, ["to_module", "to_name"], "left")
        jumped = jumped.select("module", "name", F.col("next.m").alias("to_module"), F.col("next.n").alias("to_name"), F.coalesce("next.s", F.lit("missing")).alias("state"))
        names = cut(names.filter("state <> 'open'").unionByName(jumped))
        before, left = left, names.filter("state = 'open'").count()
        if left == before:
            break
    found = F.col("state") == "declared"
    return names.select("module", "name", F.when(found, F.col("to_module")).alias("at_module"), F.when(found, F.col("to_name")).alias("at_name"), F.when(F.col("state") == "open", "cycle").otherwise(F.col("state")).alias("state"))


def bind_arguments(calls: DataFrame, bindings: DataFrame, exported: DataFrame, parameters: DataFrame) -> DataFrame:
    """Which parameter each argument meets: (call_id, position, argument, module, function, parameter).

    calls (call_id, file_path, callee, position, argument), bindings of imports
    (file_path, local, target, name; a null target is another module's),
    exported from `declared_at`, parameters (module, function, position,
    parameter). A callee that no import binds is the file's own. Arguments
    beyond the parameters, and calls of what isn't declared, are left out.
    """
    b = bindings.filter("file_path is not null and local is not null").groupBy("file_path", F.col("local").alias("callee")).agg(F.min(F.struct("target", "name")).alias("b"))
    c = calls.join(b, ["file_path", "callee"], "left")
    own = F.col("b").isNull()
    c = c.select("call_id", "position", "argument", F.when(own, F.col("file_path")).otherwise(F.col("b.target")).alias("module"), F.when(own, F.col("callee")).otherwise(F.col("b.name")).alias("name"))
    c = c.filter("module is not null and name is not null").join(exported.filter("state = 'declared'"), ["module", "name"])
    c = c.select("call_id", "position", "argument", F.col("at_module").alias("module"), F.col("at_name").alias("function"))
    return c.join(parameters.select("module", "function", "position", "parameter").distinct(), ["module", "function", "position"]).distinct().select("call_id", "position", "argument", "module", "function", "parameter")
