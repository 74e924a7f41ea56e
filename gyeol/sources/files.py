"""Files as texts: a recursive walk with the usual rules of what to read, decoding, and binary files.

Listing goes through Spark's own file source, so any store it reads will do; rules are predicates on paths.
"""

from __future__ import annotations

import os
import re
import sys
from collections.abc import Iterator
from pathlib import Path
from typing import IO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of files by name, as a caller may choose them; more come by definition.
TYPES = {
    "asciidoc": ["*.adoc", "*.asciidoc"], "avro": ["*.avdl", "*.avpr", "*.avsc"], "c": ["*.c", "*.h"], "cmake": ["*.cmake", "CMakeLists.txt"], "config": ["*.cfg", "*.conf", "*.config", "*.ini"],
    "cpp": ["*.cc", "*.cpp", "*.cxx", "*.hh", "*.hpp", "*.hxx"], "cs": ["*.cs"], "css": ["*.css", "*.scss"], "csv": ["*.csv", "*.tsv"], "docker": ["Dockerfile", "Dockerfile.*"], "go": ["*.go"],
    "html": ["*.htm", "*.html"], "java": ["*.java"], "js": ["*.cjs", "*.js", "*.jsx", "*.mjs"], "json": ["*.json", "*.jsonl"], "kotlin": ["*.kt", "*.kts"], "log": ["*.log"], "lua": ["*.lua"],
    "make": ["GNUmakefile", "Makefile", "makefile", "*.mk"], "md": ["*.markdown", "*.md", "*.mdx"], "org": ["*.org"], "perl": ["*.pl", "*.pm"], "php": ["*.php"], "protobuf": ["*.proto"],
    "py": ["*.py", "*.pyi"], "r": ["*.R", "*.Rmd", "*.r"], "rst": ["*.rst"], "ruby": ["*.gemspec", "*.rb", "Gemfile", "Rakefile"], "rust": ["*.rs"], "scala": ["*.sbt", "*.scala"], "sh": ["*.bash", "*.sh", "*.zsh"],
    "sql": ["*.sql"], "swift": ["*.swift"], "tex": ["*.bib", "*.cls", "*.sty", "*.tex"], "toml": ["*.toml"], "ts": ["*.ts", "*.tsx"], "txt": ["*.txt"], "xml": ["*.xml", "*.xsd", "*.xsl"], "yaml": ["*.yaml", "*.yml"],
}
#: Bytes of a file with a hidden name that the driver may read.
SPECIAL = 16 << 20
ENCODINGS = {"auto", "utf-8", "utf-16le", "utf-16be", "euc-kr"}


def glob_regex(glob: str, anchored: bool | None = None) -> str:
    """A glob over paths with / between; one without / may stand at any depth."""
    anchored = "/" in glob.rstrip("/") if anchored is None else anchored
    out, i, g = "", 0, glob.strip("/") if anchored else glob
    while i < len(g):
        c = g[i]
        if g.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
            continue
        if g.startswith("**", i):
            out, i = out + ".*", i + 2
            continue
        if c == "[" and (j := g.find("]", i + 2)) > 0:
            out, i = out + "[" + g[i + 1 : j].replace("!", "^", 1).replace("\\", "\\\\") + "]", j + 1
            continue
        if c == "{" and (j := g.find("}", i)) > 0:
            out, i = out + "(?:" + "|".join(glob_regex(x, True) for x in g[i + 1 : j].split(",")) + ")", j + 1
            continue
        out += {"*": "[^/]*", "?": "[^/]"}.get(c) or re.escape(c)
        i += 1
    return out


def matches_glob(path: Column, glob: str) -> Column:
    return path.rlike(f"(?:^{'' if '/' in glob.strip('/') else '|/'}){glob_regex(glob)}$")


def ignored(path: Column, rules: list[tuple[str, str]]) -> Column:
    """(folder, pattern) of ignore files, in order: the last that fits decides; ! takes back."""
    out = F.lit(False)
    for folder, rule in rules:
        rule = rule.rstrip()
        if not rule or rule.startswith("#"):
            continue
        keep, rule = rule.startswith("!"), rule.lstrip("!")
        tail = "/.*" if rule.endswith("/") else "(?:/.*)?"
        rooted = "/" in rule.rstrip("/")
        base = re.escape(folder.strip("/")) + "/" if folder.strip("/") else ""
        rx = f"^{base}{'' if rooted else '(?:.*/)?'}{glob_regex(rule.strip('/'), True)}{tail}$"
        out = F.when(path.rlike(rx), F.lit(not keep)).otherwise(out)
    return out


def _special(spark: SparkSession, root: str) -> list[tuple[str, bytes]]:
    """Files that Spark's file source leaves out, those whose own name begins with a dot or an underscore: (path under root, content). Listed and read on the
    driver through Hadoop's file systems; such files are few and small (ignore files, settings), and one over SPECIAL bytes is an error."""
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    top = fs.resolvePath(top)
    out, it = [], fs.listFiles(top, True)
    while it.hasNext():
        f = it.next()
        path = f.getPath()
        if path.getName()[:1] in "._":
            if f.getLen() > SPECIAL:
                raise ValueError(f"{path}: over {SPECIAL} bytes")
            stream = fs.open(path)
            try:
                out.append((top.toUri().relativize(path.toUri()).getPath(), bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))))
            finally:
                stream.close()
    return out


def local_folder(root: str) -> Path | None:
    """The folder of a root on the driver's own disk; None for other stores, which have neither links nor files around the root."""
    scheme, sep, rest = root.partition("://")
    path = Path(rest if sep else root.removeprefix("file:"))
    return path.resolve() if (not sep or scheme == "file") and path.is_dir() else None


def links_in(folder: Path) -> list[str]:
    """Symbolic links under a folder, as paths relative to it."""
    out = []
    for top, dirs, names in os.walk(folder):
        out += [os.path.relpath(os.path.join(top, x), folder) for x in (*dirs, *names) if os.path.islink(os.path.join(top, x))]
    return sorted(out)


def outer_rules(folder: Path) -> tuple[str, list[tuple[str, str]]]:
    """What is ignored by files outside a folder: (the folder's path below the repository it is in, rules in order: the user's own, the repository's, those of the
    folders in between). Folders of rules are relative to the repository, or to the folder where there is none."""
    top = next((p for p in (folder, *folder.parents) if (p / ".git").exists()), folder)
    user = Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "git" / "ignore"
    files = [("", user), ("", top / ".git" / "info" / "exclude")]
    for p in reversed([p for p in folder.parents if p == top or top in p.parents]):
        files += [(p.relative_to(top).as_posix().removeprefix("."), p / name) for name in (".gitignore", ".ignore")]
    rules = [(base, line) for base, f in files if f.is_file() for line in f.read_text("utf-8", "replace").splitlines()]
    return folder.relative_to(top).as_posix().removeprefix("."), rules


def default_paths(paths: list[str], piped: bool | None = None) -> list[str]:
    """The paths themselves; without any, standard input if something is piped into it, else the current folder."""
    if paths:
        return list(paths)
    piped = not (sys.stdin is None or sys.stdin.isatty()) if piped is None else piped
    return ["-"] if piped else ["."]


def present(spark: SparkSession, path: str, issues: list[tuple[str, str, str]]) -> bool:
    """Whether a path can be listed; if not, an issue says why."""
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        top.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(top)
    except Exception as e:  # noqa: BLE001
        issues.append((path, "walk", str(getattr(e, "java_exception", e)).partition("\n")[0]))
        return False
    return True


def issue_rows(spark: SparkSession, issues: list[tuple[str, str, str]], files: DataFrame | None = None) -> DataFrame:
    """path, kind, message: what could not be read. kind: walk (a path that is not there), or input (a file whose bytes are not all text). A search goes on without them."""
    out = spark.createDataFrame(issues, "path string, kind string, message string")
    if files is not None:
        bad = decoded(files).where("NOT valid_utf8 AND text IS NOT NULL")
        out = out.unionByName(bad.select("path", F.lit("input").alias("kind"), F.lit("bytes that are no UTF-8 match nothing").alias("message")))
    return out


def read_files(spark: SparkSession, paths: list[str], globs: list[str] = (), types: list[str] = (), define: list[str] = (), hidden: bool = False, no_ignore: bool = False, explicit: list[str] = (), issues: list[tuple[str, str, str]] | None = None, follow: bool = False, stdin: IO[bytes] | None = None) -> DataFrame:
    """path (relative to the root it was found under), content, length. globs beginning with ! exclude; explicit files are read whatever the rules say.

    The path - is standard input (stdin), which is read once however often it is named. Symbolic links are passed over unless follow is set; ignore files count from the repository's root on.

    issues: where given, a path that is not there is noted in it and passed over, and files that vanish or are broken when they are read are passed over; else they are errors."""
    kinds = {k: list(v) for k, v in TYPES.items()}
    for d in define:
        name, _, g = d.partition(":")
        kinds.setdefault(name, []).append(g)
    out = None
    roots, calm = list(dict.fromkeys(paths or ["."])), issues is not None
    if "-" in roots:
        roots.remove("-")
        data = (stdin or sys.stdin.buffer).read()
        out = spark.createDataFrame([("-", bytearray(data), len(data))], "path string, content binary, length long")
    if calm:
        roots, explicit = [p for p in roots if present(spark, p, issues)], [p for p in explicit if present(spark, p, issues)]
    source = lambda: spark.read.format("binaryFile").option("ignoreMissingFiles", calm).option("ignoreCorruptFiles", calm)
    if not roots and out is None:
        out = spark.createDataFrame([], "path string, content binary, length long")
    for root in roots:
        raw = source().option("recursiveFileLookup", True).load(root)
        prefix = re.escape(root.split("://")[-1].rstrip("/"))
        df = raw.select(F.regexp_replace("path", rf"^[a-z0-9+.-]+:/*(?=/)(?:/[^/]*(?=/))?.*?{prefix}/", "").alias("path"), "content", "length")
        special = _special(spark, root)
        extra = [(p, bytearray(c), len(c)) for p, c in special]
        if extra:
            df = df.unionByName(spark.createDataFrame(extra, "path string, content binary, length long"))
        folder = local_folder(root)
        if folder and not follow:
            for link in links_in(folder):
                df = df.where((F.col("path") != link) & ~F.startswith("path", F.lit(f"{link}/")))
        if not no_ignore:
            files = sorted(((p, c) for p, c in special if p.rpartition("/")[2] in (".gitignore", ".ignore")), key=lambda x: (x[0].count("/"), x[0]))
            rules = [(p.rpartition("/")[0], line) for p, c in files for line in c.decode("utf-8", "replace").splitlines()]
            below, outer = outer_rules(folder) if folder else ("", [])
            rules = outer + [(f"{below}/{base}".strip("/"), line) for base, line in rules]
            if rules:
                df = df.where(~ignored(F.concat(F.lit(f"{below}/" if below else ""), F.col("path")), rules))
        if not hidden:
            df = df.where(~F.col("path").rlike(r"(?:^|/)\."))
        yes, no = [g for g in globs if not g.startswith("!")], [g[1:] for g in globs if g.startswith("!")]
        for group in (yes, [g for t in types for g in kinds[t]]):
            if group:
                test = F.lit(False)
                for g in group:
                    test = test | matches_glob(F.col("path"), g)
                df = df.where(test)
        for g in no:
            df = df.where(~matches_glob(F.col("path"), g))
        out = df if out is None else out.unionByName(df)
    for p in explicit:
        one = source().load(p).select(F.lit(p).alias("path"), "content", "length")
        out = out.join(one.select("path"), "path", "left_anti").unionByName(one)
    return out


def decoded(files: DataFrame, encoding: str = "auto") -> DataFrame:
    """path, text, binary_byte_offset, valid_utf8. Text ends before the first NUL, whose offset is kept; a byte order mark decides in auto and is dropped."""
    if encoding not in ENCODINGS:
        raise ValueError(f"unknown encoding {encoding}")
    c = F.col("content")
    if encoding == "euc-kr":

        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                yield pa.RecordBatch.from_arrays([b["path"], pa.array([None if x is None else x.decode("cp949", "replace") for x in b["content"].to_pylist()], pa.string())], ["path", "t"])

        df = files.select("path", "content").mapInArrow(rows, "path string, t string").withColumn("valid", F.lit(True))
    else:
        mark = F.hex(F.substring(c, 1, 2))
        le, be = (F.lit(encoding == "utf-16le"), F.lit(encoding == "utf-16be")) if encoding != "auto" else (mark == "FFFE", mark == "FEFF")
        utf8 = F.when(F.hex(F.substring(c, 1, 3)) == "EFBBBF", F.substring(c, 4, 2**31 - 1)).otherwise(c)
        t = F.when(le, F.decode(c, "UTF-16LE")).when(be, F.decode(c, "UTF-16BE")).otherwise(utf8.cast("string"))
        mark = F.lit("\ufeff")  # no regular expression here: it would turn bytes that are no UTF-8 into others
        df = files.select("path", F.when(F.startswith(t, mark), F.substring(t, 2, 2**31 - 1)).otherwise(t).alias("t"), (le | be | F.is_valid_utf8(utf8.cast("string"))).alias("valid"))
    at = F.instr("t", "\0")
    return df.select("path", F.when(at > 0, F.substring("t", F.lit(1), at - 1)).otherwise(F.col("t")).alias("text"), F.when(at > 0, F.octet_length(F.substring("t", F.lit(1), at - 1)).cast("long")).alias("binary_byte_offset"), F.col("valid").alias("valid_utf8"))


def in_memory(spark: SparkSession, texts: dict[str, str]) -> DataFrame:
    """Texts of one's own, as path and text; standard input is the path '-'."""
    return spark.createDataFrame(list(texts.items()), "path string, text string")
