"""Import statements of source files and the files of their graph that they mean.

Statements are read by patterns, candidates are made as columns in the order of each language's rules, and the first
candidate that exists is found by an equi-join with the files. Languages whose imports mean a folder (Go, Swift) are joined
on the folder. An import that means no file of the graph has no row.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.paths import basename
from graphloom.operators.intervals import first_candidate, nearest_ancestor

# Endings tried behind a path without one, and what a compiled ending may have been made from.
SCRIPT_PROBES = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
COMPILED_FROM = {".js": (".ts", ".tsx", ".js", ".jsx"), ".jsx": (".tsx", ".jsx"), ".mjs": (".mts", ".mjs", ".ts"), ".cjs": (".cts", ".cjs", ".ts")}

_ARRAY = "array<string>"


def folder(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", "")).otherwise("")


def joined(base: Column, relative: Column) -> Column:
    """Path of a relative reference from a folder; null where it leaves the root."""
    parts = F.split(F.concat_ws("/", F.nullif(base, F.lit("")), relative), "/")
    step = lambda acc, p: F.when((p == "") | (p == "."), acc).when(p == "..", F.when(F.coalesce(F.size(acc) > 0, F.lit(False)), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast(_ARRAY), step), "/")


def ancestors(path: Column) -> Column:
    """Folders above a path, the nearest first, the root (empty) last."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def _within(base: Column, rest: Column) -> Column:
    return F.when(base == "", rest).otherwise(F.concat(base, F.lit("/"), rest))


def statements(files: DataFrame, ending: str, pattern: str, group: int = 1) -> DataFrame:
    """graphId, importer, source of each distinct match of a pattern in files of an ending (a pattern without its dot)."""
    f = files.where(F.col("path").rlike(rf"\.(?:{ending})$") & F.col("content").isNotNull())
    return f.select("graphId", F.col("path").alias("importer"), F.explode(F.regexp_extract_all("content", F.lit(pattern), F.lit(group))).alias("source")).distinct()


def _first(candidates: DataFrame, files: DataFrame) -> DataFrame:
    return first_candidate(candidates, files.select("graphId", "path").distinct(), ["graphId", "importer", "source"], ["graphId"])


def probes(base: Column) -> Column:
    """Paths tried for a script reference, in order: itself, then its sources if the ending is a compiled one, else endings."""
    compiled = None
    for ending, sources in COMPILED_FROM.items():
        stem = F.substring(base, F.lit(1), F.length(base) - len(ending))
        made = F.concat(F.array(base), F.array(*[F.concat(stem, F.lit(s)) for s in sources]))
        compiled = F.when(base.endswith(ending), made) if compiled is None else compiled.when(base.endswith(ending), made)
    return compiled.otherwise(F.concat(F.array(base), F.array(*[F.concat(base, F.lit(s)) for s in SCRIPT_PROBES])))


def script_imports(files: DataFrame) -> DataFrame:
    """import, export from and require of scripts: relative paths, and aliases of the nearest tsconfig.json."""
    every = statements(files, "tsx?|jsx?|mjs|cjs|mts|cts", r"""(?m)^\s*(?:import|export)\b[^;'"]*?['"]([^'"\n]+)['"]""").union(statements(files, "tsx?|jsx?|mjs|cjs|mts|cts", r"""\brequire\(\s*['"]([^'"\n]+)['"]\s*\)""")).distinct()
    relative = every.where("source like './%' or source like '../%'").withColumn("candidates", probes(joined(folder(F.col("importer")), F.col("source"))))
    options = F.from_json(F.regexp_replace("content", r"(?m)^\s*//.*$|,(?=\s*[}\]])", ""), "compilerOptions struct<baseUrl:string,paths:map<string,array<string>>>")["compilerOptions"]
    configs = files.where(basename(F.col("path")) == "tsconfig.json").select("graphId", folder(F.col("path")).alias("folder"), options.alias("o")).where("o.paths is not null")
    configs = configs.select("graphId", "folder", F.coalesce("o.baseUrl", F.lit("")).alias("root"), F.explode("o.paths").alias("alias", "targets")).select("graphId", "folder", "root", "alias", F.posexplode("targets").alias("nth", "target"))
    bare = every.where("not (source like './%' or source like '../%' or source like '/%')")
    nearest = nearest_ancestor(bare.select("graphId", F.col("importer").alias("path")).distinct(), configs.select("graphId", "folder").distinct(), ["graphId"]).withColumnRenamed("path", "importer")
    head, tail = F.substring_index("alias", "*", 1), F.when(F.instr("alias", "*") > 0, F.substring_index("alias", "*", -1))
    fits = F.when(tail.isNull(), F.col("source") == F.col("alias")).otherwise(F.startswith("source", head) & F.endswith("source", tail) & (F.length("source") >= F.length(head) + F.length(tail)))
    middle = F.when(tail.isNull(), "").otherwise(F.substring(F.col("source"), F.length(head) + 1, F.length("source") - F.length(head) - F.length(tail)))
    star = F.instr("target", "*") > 0
    to = F.when(star, F.concat(F.substring_index("target", "*", 1), middle, F.substring_index("target", "*", -1))).otherwise(F.col("target"))
    a = bare.join(nearest, ["graphId", "importer"]).join(configs, ["graphId", "folder"]).where(fits)
    a = a.withColumn("c", probes(joined(_within(F.col("folder"), F.col("root")), to)))
    # The more of the name an alias fixes, the earlier it is tried; then its targets in order.
    a = a.groupBy("graphId", "importer", "source").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((-F.length(head)).alias("k"), F.col("alias"), "nth", "c"))), lambda x: x["c"])).alias("candidates"))
    return _first(relative.unionByName(a), files)


def python_imports(files: DataFrame) -> DataFrame:
    """import and from of Python: relative by dots, else below the nearest folder above in which the module exists; modules, packages and submodules."""
    one = statements(files, "pyi?", r"(?m)^[ \t]*from[ \t]+(\.*[\w.]*[ \t]+import[ \t]+\(?[\w \t,*]+)")
    named = one.select("graphId", "importer", F.regexp_extract("source", r"^(\.*[\w.]*)", 1).alias("source"), F.explode(F.split(F.regexp_replace("source", r"^\.*[\w.]*\s+import\s+\(?", ""), ",")).alias("name"))
    named = named.select("graphId", "importer", "source", F.regexp_extract("name", r"^\s*(\w+)", 1).alias("name"))
    plain = statements(files, "pyi?", r"(?m)^[ \t]*import[ \t]+([\w., \t]+)").select("graphId", "importer", F.explode(F.split("source", ",")).alias("source"))
    plain = plain.select("graphId", "importer", F.regexp_extract("source", r"^\s*([\w.]+)", 1).alias("source"), F.lit("").alias("name"))
    every = named.unionByName(plain).where("source <> ''").distinct()
    dots = F.length(F.regexp_extract("source", r"^(\.*)", 1))
    up = F.array_join(F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0))), "/")
    rest = F.regexp_replace(F.regexp_replace("source", r"^\.+", ""), r"\.", "/")
    roots = F.when(dots > 0, F.array(joined(folder(F.col("importer")), up))).otherwise(ancestors(F.col("importer")))
    c = every.select("graphId", "importer", "source", "name", rest.alias("rest"), F.posexplode(roots).alias("level", "root")).where("root is not null")
    base = F.when(F.col("rest") == "", F.col("root")).otherwise(_within(F.col("root"), F.col("rest")))
    tries = F.array(F.concat(base, F.lit(".py")), _within(base, F.lit("__init__.py")), F.when(F.col("name") != "", _within(base, F.concat("name", F.lit(".py")))), F.when(F.col("name") != "", _within(base, F.concat("name", F.lit("/__init__.py")))))
    c = c.select("graphId", "importer", "source", "level", F.explode(F.array_compact(tries)).alias("path"))
    hit = c.join(files.select("graphId", "path").distinct(), ["graphId", "path"])
    nearest = hit.groupBy("graphId", "importer", "source").agg(F.min("level").alias("level"))
    return hit.join(nearest, ["graphId", "importer", "source", "level"]).select("graphId", "importer", "source", "path").distinct()


def go_imports(files: DataFrame) -> DataFrame:
    """Imports below the module of the nearest go.mod: every Go file of the folder they name."""
    block = statements(files, "go", r"(?s)\bimport\s*\(([^)]*)\)").select("graphId", "importer", F.explode(F.regexp_extract_all("source", F.lit(r'"([^"\n]+)"'), F.lit(1))).alias("source"))
    every = block.union(statements(files, "go", r'(?m)^import[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]+)"')).distinct()
    mods = files.where(basename(F.col("path")) == "go.mod").select("graphId", folder(F.col("path")).alias("folder"), F.regexp_extract("content", r"(?m)^module[ \t]+(\S+)", 1).alias("module")).where("module <> ''")
    nearest = nearest_ancestor(every.select("graphId", F.col("importer").alias("path")).distinct(), mods.select("graphId", "folder").distinct(), ["graphId"]).withColumnRenamed("path", "importer")
    j = every.join(nearest, ["graphId", "importer"]).join(mods, ["graphId", "folder"]).where((F.col("source") == F.col("module")) | F.startswith("source", F.concat("module", F.lit("/"))))
    rest = F.substring(F.col("source"), F.length("module") + 2, F.length("source"))
    j = j.select("graphId", "importer", "source", F.when(rest == "", F.col("folder")).otherwise(_within(F.col("folder"), rest)).alias("dir"))
    go = files.where("path like '%.go'").select("graphId", "path", folder(F.col("path")).alias("dir")).distinct()
    return j.join(go, ["graphId", "dir"]).select("graphId", "importer", "source", "path")


def _by_tail(refs: DataFrame, files: DataFrame, ending: str) -> DataFrame:
    """Files whose path ends with the reference's ``tail`` at a folder border."""
    parts = F.split("path", "/")
    tails = files.where(F.col("path").endswith(ending)).select("graphId", "path").distinct().withColumn("tail", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))))
    return refs.join(tails, ["graphId", "tail"]).select("graphId", "importer", "source", "path").distinct()


def dotted_imports(files: DataFrame, language: str) -> DataFrame:
    """Dotted names of Java, Kotlin and C#: files whose path ends with the name as a path; wildcards mean no file."""
    ending, pattern = {"java": ("java", r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;"), "kotlin": ("kts?", r"(?m)^[ \t]*import[ \t]+([\w.]+)(?:[ \t]+as[ \t]+\w+)?[ \t]*;?[ \t]*$"), "csharp": ("cs", r"(?m)^[ \t]*using[ \t]+(?:static[ \t]+)?([\w.]+)[ \t]*;")}[language]
    ext = {"java": ".java", "kotlin": ".kt", "csharp": ".cs"}[language]
    s = statements(files, ending, pattern).withColumn("tail", F.concat(F.regexp_replace("source", r"\.", "/"), F.lit(ext)))
    return _by_tail(s, files, ext)


def scala_imports(files: DataFrame) -> DataFrame:
    """Names, selectors and package objects of Scala."""
    s = statements(files, "scala|sc", r"(?m)^[ \t]*import[ \t]+(\w+(?:\.\w+)*(?:\.\{[^}]*\}|\.[_*])?)")
    package, names = F.regexp_extract("source", r"^([\w.]+?)(?:\.\{|\.[_*]?$|$)", 1), F.regexp_extract("source", r"\{([^}]*)\}", 1)
    full = F.when(names != "", F.transform(F.split(names, ","), lambda x: F.concat(package, F.lit("."), F.regexp_extract(x, r"^\s*(\w+)", 1)))).otherwise(F.array(package))
    s = s.withColumn("name", F.explode(full))
    slashed = F.regexp_replace("name", r"\.", "/")
    s = s.withColumn("tail", F.explode(F.array(F.concat(slashed, F.lit(".scala")), F.concat(F.regexp_replace(slashed, "/[^/]*$", ""), F.lit("/package.scala")))))
    return _by_tail(s.drop("name"), files, ".scala")


def swift_imports(files: DataFrame) -> DataFrame:
    """Modules of Swift: every file below Sources/<module>, Tests/<module> or a top folder of that name."""
    s = statements(files, "swift", r"(?m)^[ \t]*(?:@testable[ \t]+)?import[ \t]+(?:(?:struct|class|enum|protocol|func|var|let|typealias)[ \t]+)?(\w+)")
    module = F.coalesce(F.nullif(F.regexp_extract("path", r"(?:^|/)(?:Sources|Tests)/([^/]+)/", 1), F.lit("")), F.nullif(F.regexp_extract("path", r"^([^/]+)/", 1), F.lit("")))
    own = files.where("path like '%.swift'").select("graphId", "path", module.alias("source")).distinct()
    return s.join(own, ["graphId", "source"]).where("importer <> path").select("graphId", "importer", "source", "path")


def ruby_imports(files: DataFrame) -> DataFrame:
    """require_relative from the importer's folder; require below lib, app and the root."""
    f = files.withColumn("content", F.regexp_replace("content", r"(?m)#.*$", ""))
    rb = lambda c: F.when(c.endswith(".rb"), c).otherwise(F.concat(c, F.lit(".rb")))
    rel = statements(f, "rb|rake", r"""\brequire_relative[ \t(]+['"]([^'"\n]+)['"]""").withColumn("candidates", F.array(rb(joined(folder(F.col("importer")), F.col("source")))))
    absolute = statements(f, "rb|rake", r"""\brequire[ \t(]+['"]([^'"\n]+)['"]""").withColumn("candidates", F.array(*[rb(F.concat(F.lit(p), F.col("source"))) for p in ("lib/", "app/", "")]))
    return _first(rel.unionByName(absolute), files)


def php_imports(files: DataFrame) -> DataFrame:
    """Names of PHP by the longest PSR-4 prefix of the nearest composer.json."""
    s = statements(files, "php", r"(?m)^[ \t]*use[ \t]+(?:function[ \t]+|const[ \t]+)?\\?([\w\\]+)")
    maps = F.from_json("content", "autoload struct<`psr-4`:map<string,string>>")["autoload"]["psr-4"]
    c = files.where(basename(F.col("path")) == "composer.json").select("graphId", folder(F.col("path")).alias("folder"), maps.alias("m")).where("m is not null").select("graphId", "folder", F.explode("m").alias("prefix", "dir"))
    nearest = nearest_ancestor(s.select("graphId", F.col("importer").alias("path")).distinct(), c.select("graphId", "folder").distinct(), ["graphId"]).withColumnRenamed("path", "importer")
    j = s.join(nearest, ["graphId", "importer"]).join(c, ["graphId", "folder"]).where(F.startswith("source", F.col("prefix")))
    rest = F.translate(F.substring(F.col("source"), F.length("prefix") + 1, F.length("source")), "\\", "/")
    path = joined(F.col("folder"), F.concat(F.regexp_replace("dir", "/$", ""), F.lit("/"), rest, F.lit(".php")))
    j = j.groupBy("graphId", "importer", "source").agg(F.max_by(path, F.length("prefix")).alias("path"))
    return j.join(files.select("graphId", "path").distinct(), ["graphId", "path"]).select("graphId", "importer", "source", "path")


def rust_imports(files: DataFrame) -> DataFrame:
    """mod declarations beside their file, and use of crate, self and super below the nearest Cargo.toml's src."""
    mods = statements(files, "rs", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?mod[ \t]+(\w+)[ \t]*;")
    stem = F.regexp_replace("importer", r"\.rs$", "")
    root = F.col("importer").rlike(r"(?:^|/)(?:mod|lib|main)\.rs$")
    own = F.when(root, folder(F.col("importer"))).otherwise(stem)
    mods = mods.withColumn("candidates", F.array(_within(own, F.concat("source", F.lit(".rs"))), _within(own, F.concat("source", F.lit("/mod.rs")))))
    uses = statements(files, "rs", r"(?m)^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?use[ \t]+((?:crate|self|super)(?:::\w+)+)")
    crates = files.where(basename(F.col("path")) == "Cargo.toml").select("graphId", folder(F.col("path")).alias("folder")).distinct()
    nearest = nearest_ancestor(uses.select("graphId", F.col("importer").alias("path")).distinct(), crates, ["graphId"]).withColumnRenamed("path", "importer")
    j = uses.join(nearest, ["graphId", "importer"], "left")
    up = F.when(F.startswith("source", F.lit("crate")), _within(F.coalesce("folder", F.lit("")), F.lit("src"))).when(F.startswith("source", F.lit("self")), own).otherwise(folder(own))
    parts = F.slice(F.split("source", "::"), 2, 1 << 10)
    # The last names may be items of a module: ever shorter paths are tried.
    tries = F.flatten(F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda i: F.array(F.concat(up, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"), F.lit(".rs")), F.concat(up, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/"), F.lit("/mod.rs")))))
    return _first(mods.unionByName(j.withColumn("candidates", tries).select("graphId", "importer", "source", "candidates")), files)


def c_includes(files: DataFrame) -> DataFrame:
    """Quoted includes of C and C++: beside the importer, below include or src, else the only file whose path ends so."""
    s = statements(files, "c|h|cc|cpp|cxx|hpp|hxx", r'(?m)^[ \t]*#[ \t]*include[ \t]+"([^"\n]+)"')
    near = _first(s.withColumn("candidates", F.array(joined(folder(F.col("importer")), F.col("source")), F.concat(F.lit("include/"), F.col("source")), F.concat(F.lit("src/"), F.col("source")), F.col("source"))), files)
    rest = s.join(near.select("graphId", "importer", "source"), ["graphId", "importer", "source"], "left_anti").withColumn("tail", F.regexp_replace("source", r"^(?:\.{1,2}/)+", ""))
    far = _by_tail(rest, files, "").groupBy("graphId", "importer", "source").agg(F.min("path").alias("path"), F.count("*").alias("n")).where("n = 1").drop("n")
    return near.select("graphId", "importer", "source", "path").unionByName(far.select("graphId", "importer", "source", "path"))


RESOLVERS = {
    "script": script_imports, "python": python_imports, "go": go_imports, "java": lambda f: dotted_imports(f, "java"), "kotlin": lambda f: dotted_imports(f, "kotlin"), "csharp": lambda f: dotted_imports(f, "csharp"),
    "scala": scala_imports, "swift": swift_imports, "ruby": ruby_imports, "php": php_imports, "rust": rust_imports, "c": c_includes,
}


def import_map(files: DataFrame) -> DataFrame:
    """graphId, importer, path of every import that means a file of the graph, each once, not of itself.

    files: graphId, path, content. Files of languages without a resolver import nothing.
    """
    f = files.select("graphId", "path", "content").where("path is not null")
    parts = [r(f).select("graphId", "importer", "path") for r in RESOLVERS.values()]
    return reduce(DataFrame.union, parts).where("importer <> path").distinct()
