"""Generated, minified, vendored and blob files among hand-written source.

Evidence from each file (how it announces itself, how regular its lines are,
how dense its text is) and from the corpus (the same file in several
repositories, names of packages kept in vendor folders) enters a directory
tree as node potentials. Sum-product belief propagation, upward and downward
level by level, combines it with parent and sibling compatibilities: siblings
of one extension form a group that tends to share a label, groups tend to have
their folder's, folders their parent's."""

from __future__ import annotations

import functools
import math
import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import Scratch, skew_join

LABELS = ("handwritten", "generated", "minified", "vendored", "blob")
#: Probability that a file has the label of its siblings of one extension, and such a group or a folder that of its parent.
FILE_STAYS, FOLDER_STAYS = 0.8, 0.75
#: Characters, and lines, from which on evidence of content comes near its full weight.
CHARS, LINES = 150.0, 4.0
#: Prior of the label at the top of a repository.
PRIOR = (0.9, 0.03, 0.02, 0.03, 0.02)
#: A content in so many repositories is a third-party copy.
SHARED_REPOS = 2

_SAYS_GENERATED = re.compile(
    r"@generated\b|<auto-?generated>|\bauto-?(?:matically[ -])?generated\b|automatically generated|\b(?:code|file|source|stubs?) (?:is |was )?generated\b|"
    r"\bgenerated (?:by|from|with|using|on)\b|\bdo not (?:edit|modify|change|make (?:direct|manual) changes)|(?:manual )?(?:edits|changes) (?:are|will be) (?:over-?written|lost)|"
    r"\bre-?run `[^`]+`|\bsource checksum\b",
    re.I,
)
_SAYS_OWN = re.compile(r"edit freely|by hand|hand-?(?:written|maintained|edited|crafted)|manually (?:written|maintained)|safe to edit|at (?:start-?up|run-?time)", re.I)
_SAYS_VENDORED = re.compile(r"\blicen[cs]ed? (?:in|under|as|file)|\bunder (?:a|an|the) [\w. -]{0,40}licen[cs]e|\blicen[cs]e\s*\||\bfree licen[cs]e|contributors\b|keep this notice|@license|SPDX-License|\bdistributed under\b|\bupstream\b|\bvendored\b", re.I)
_SAYS_BUNDLE = re.compile(r"built bundle|sourceMappingURL=|webpack|\bbundled\b|minified", re.I)
_COMMENT = re.compile(r"^\s*(?://|#|/\*|\*|--|<!--|\"\"\")")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")
_PATH = {
    1: re.compile(r"(?:^|/)(?:_*generated_*|gen|autogen|codegen-out)/|[._](?:gen|generated|pb|g|auto)\.|_pb2?(?:_grpc)?\.|(?:^|/)zz_generated", re.I),
    2: re.compile(r"[.-](?:min|bundle|prod|packed)\.(?:js|css|mjs)$|\.[0-9a-f]{6,}\.(?:js|css)$|(?:^|/)dist/|(?:^|/)static/js/|(?:^|/)public/js/", re.I),
    # a package kept below such a folder, or a file with a version in it; a module may well be about vendors
    3: re.compile(r"(?:^|/)(?:vendor|node_modules|third[_-]?party|external|externals|deps|contrib|bower_components|\.yarn|libs)/(?:[^/]+/|[^/]*[-.@]v?\d+(?:\.\d+)+[^/]*$)", re.I),
    4: re.compile(r"(?:^|/)(?:fixtures|icons|testdata|seeds)/", re.I),
}


_QUOTED, _NUMBER = re.compile(r"\"[^\"]*\"|'[^']*'|`[^`]*`"), re.compile(r"\d+(?:\.\d+)?")


@functools.lru_cache(maxsize=100_000)
def line_shape(line: str) -> str:
    """A line without its names, numbers and strings."""
    s = _WORD.sub(lambda m: m[0] if m[0] in _KEEP else "a", _QUOTED.sub("s", line.strip()))
    return _NUMBER.sub("0", s)


#: Words that shape a line in common languages.
_KEEP = frozenset("if else for while return func def class import from export const let var function async await type interface enum package struct new throw try catch nil null None self this".split())


def regularity(shapes: list[str]) -> float:
    """Greatest share of lines that equal the line some fixed distance before,
    over the lines that have such a line. All distances up to a third of the
    lines are ranked at once by the autocorrelation of random signs of the
    shapes; the first eight and the eight highest are then counted."""
    n = len(shapes)
    most = n // 3
    if n < 6 or most < 1:
        return 0.0
    number: dict[str, int] = {}
    ids = np.array([number.setdefault(x, len(number)) for x in shapes])
    tried = set(range(1, min(8, most) + 1))
    if most > 8:
        signs = np.random.default_rng(7).choice([-1.0, 1.0], size=(8, len(number)))[:, ids]
        spectrum = np.abs(np.fft.rfft(signs, 2 * n, axis=1)) ** 2
        match = np.fft.irfft(spectrum.sum(axis=0), 2 * n)[: most + 1] / (8 * (n - np.arange(most + 1)))
        tried |= {int(p) for p in np.argsort(-match[1:])[:8] + 1}
    return max(float((ids[p:] == ids[:-p]).mean()) for p in tried)


def _grows(size: float, scale: float) -> float:
    """A weight that grows with the size of what it rests on, towards 1."""
    return 1.0 - math.exp(-size / scale)


def evidence(path: str | None, content: str | None) -> list[float]:
    """Log-odds of the five labels from one file; an empty file says nothing."""
    text = content or ""
    e = [0.0] * 5
    for k, pattern in _PATH.items():
        if pattern.search(path or ""):
            e[k] += 1.5 if k == 4 else 2.0
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        return e
    # the leading comment, up to the first line of code after line 12 at least, and the trailing one
    first = next((i for i, x in enumerate(lines) if i >= 12 and not _COMMENT.match(x)), len(lines))
    last = next((i for i in range(len(lines) - 1, -1, -1) if len(lines) - i > 6 and not _COMMENT.match(lines[i])), -1)
    head = "\n".join(x for i, x in enumerate(lines) if (i < first or i > last) and _COMMENT.match(x))
    inner_notes = "\n".join(x for x in lines[first : last + 1] if _COMMENT.match(x))
    own = bool(_SAYS_OWN.search(head))
    if _SAYS_GENERATED.search(head):
        e[1 if not own else 0] += 6.0 if not own else 2.0
    elif not own and _SAYS_GENERATED.search(inner_notes):
        e[1] += 1.5
    if _SAYS_VENDORED.search(head):
        e[3] += 6.0
    elif _SAYS_VENDORED.search(inner_notes):
        e[3] += 1.0
    code = [x for x in lines if not _COMMENT.match(x)]
    if not code:
        return e
    size = sum(map(len, code))
    words = [m for x in code for m in _WORD.findall(x)]
    names = [w for w in words if w not in _KEEP]
    short = sum(len(w) <= 2 for w in names) / max(1, len(names))
    spaces = sum(x.count(" ") + x.count("\t") for x in code) / size
    mean = size / len(code)
    if (mean > 110 or size > 400 and len(code) <= 2) and short > 0.4 and spaces < 0.12:
        e[2] += 6.0
    elif mean > 300 and spaces < 0.12 or short > 0.6 and spaces < 0.08:
        e[2] += 3.0
    if re.search(r"\.(?:js|css|mjs)$", path or "") and _SAYS_BUNDLE.search(head):
        e[2] += 3.0
    inner = code[1:-1] or code
    data = sum(bool(_DATA.match(x)) for x in inner) / len(inner)
    if data > 0.85:
        e[4] += 6.5 * _grows(len(text), CHARS)
    elif max(map(len, code)) > 400 and re.search(r"[A-Za-z0-9+/=\\x]{300,}", text):
        e[4] += 5.0
    shapes = [line_shape(x) for x in code]
    r = regularity(shapes)
    if data < 0.5 and e[2] < 3:
        if r > 0.85:
            e[1] += 3.9 * _grows(len(code), LINES)
        elif r < 0.5:
            e[0] += 1.0
    if e[1:] == [0.0] * 4:
        e[0] += 1.0
    return e


# A line of values and keys only. Each sign can be read in one way, so that a
# line that is none fails in time linear in its length.
_DATA = re.compile(r"^(?:[\[\](){},;|\s]|\"[^\"]*\"|'[^']*'|[\w.+/=-]++\s*+[:;,|]|(?:[^\W\d]++(?:-?\d[\w.+-]*+)?|-?\d[\w.+-]*+)(?![\w.+/=-]))++$(?<![{(])")


def _pass(cols: list[Column], stays: float) -> list[Column]:
    """A message over an edge: the receiver keeps the sender's label with
    probability stays, else has any other. Up to a constant, which no label
    notices."""
    top = F.greatest(*cols)
    near = [F.exp(c - top) for c in cols]
    other = (1 - stays) / 4
    whole = near[0]
    for x in near[1:]:
        whole = whole + x
    return [F.log(whole * other + x * (stays - other)) for x in near]


_B = [f"b{i}" for i in range(5)]
_M = [f"m{i}" for i in range(5)]


def _parent(path: Column) -> Column:
    """Folder of a path; '' is the top of a repository."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise("")


def _group(path: Column) -> Column:
    """The group of a file's siblings of one extension, as a folder below
    the folder of both."""
    tail = F.concat(F.lit("\u0001"), F.regexp_extract(path, r"(\.[^./]*)?$", 0))
    return F.when(F.instr(path, "/") > 0, F.concat(_parent(path), F.lit("/"), tail)).otherwise(tail)


def _depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def file_evidence(files: DataFrame, scratch: Scratch) -> DataFrame:
    """repo_id, file_path, dir, b0..b4 (log-odds), one row for each file."""

    @F.pandas_udf("array<double>")
    def own(paths: pd.Series, contents: pd.Series) -> pd.Series:
        return pd.Series([evidence(p, c) for p, c in zip(paths, contents)])

    one = files.where("file_path is not null").groupBy(F.coalesce("repo_id", F.lit("")).alias("repo_id"), "file_path").agg(F.min(F.coalesce("content", F.lit(""))).alias("content"))
    flat = F.regexp_replace(F.lower("content"), r"\s+", " ")
    # a copy may have lost its banner: what is compared starts after the leading comment
    body = F.regexp_replace(flat, r"^(?:\s*(?:/\*.*?\*/|\"\"\".*?\"\"\"))?", "")
    kept = scratch.keep(one.select("repo_id", "file_path", own("file_path", "content").alias("e"), F.when(F.length(body) > 0, F.sha2(body, 256)).alias("body"), F.length(body).alias("body_chars")))
    repos = kept.where("body is not null").groupBy("body").agg(F.count_distinct("repo_id").alias("n")).where(F.col("n") >= SHARED_REPOS).select("body", F.lit(1).alias("shared"))
    stem = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"[-.][0-9][\w.]*(?=\.)|\.[^.]*$", "")
    tokens = F.array_distinct(F.concat(F.split(F.lower("file_path"), r"[/._-]"), F.array(F.lower(stem))))
    package = F.regexp_extract(F.lower("file_path"), r"(?:^|/)(?:vendor|node_modules|third[_-]?party|external|deps|\.yarn/cache)/([a-z@][\w@]*?)(?:-[0-9][\w.]*)?/", 1)
    # a name is a package where several repositories keep it in such a folder
    packages = kept.select("repo_id", package.alias("t")).where(F.length("t") > 3).groupBy("t").agg(F.count_distinct("repo_id").alias("n")).where(F.col("n") >= SHARED_REPOS).select("t")
    named = kept.select("repo_id", "file_path", F.explode(tokens).alias("t")).join(packages, "t", "left_semi").select("repo_id", "file_path").distinct().withColumn("named", F.lit(1))
    joined = skew_join(kept, repos, ["body"], "left").join(named, ["repo_id", "file_path"], "left")
    # the shorter a shared content, the less it says
    told = 1 - F.exp(-F.col("body_chars") / CHARS)
    extra = F.when(F.col("shared") == 1, 4.0 * told).otherwise(0.0) + F.when(F.col("named") == 1, 2.5).otherwise(0.0)
    return scratch.keep(joined.select("repo_id", "file_path", _group(F.col("file_path")).alias("dir"), *[(F.col("e")[i] + (extra if i == 3 else 0.0)).alias(f"b{i}") for i in range(5)]))


def label_files(files: DataFrame) -> DataFrame:
    """repo_id, file_path, label, certainty: one row for each file.

    Repeated rows of a file count once (the least content); a null repo_id is
    '' and a repository of its own; a null file_path is no file; null and
    empty contents are judged by their place. Whole contents are read, and
    statistics run over all files."""
    scratch = Scratch(files.sparkSession, "provenance")
    leaves = file_evidence(files, scratch)
    up = leaves.select("repo_id", "dir", *[c.alias(m) for c, m in zip(_pass([F.col(b) for b in _B], FILE_STAYS), _M)])
    sums = [F.sum(m).alias(b) for m, b in zip(_M, _B)]
    # by depth, so that each level reads its own folders only
    from_files = scratch.keep(up.groupBy("repo_id", "dir").agg(*sums).withColumn("depth", _depth(F.col("dir"))), by="depth")
    deepest = from_files.agg(F.max("depth")).first()[0] or 0
    levels: dict[int, DataFrame] = {}
    rising = None
    for k in range(deepest, -1, -1):
        here = from_files.where(F.col("depth") == k).drop("depth")
        if rising is not None:
            here = here.unionByName(rising).groupBy("repo_id", "dir").agg(*[F.sum(b).alias(b) for b in _B])
        messages = _pass([F.col(b) for b in _B], FOLDER_STAYS)
        levels[k] = scratch.keep(here.select("repo_id", "dir", *_B, *[c.alias(m) for c, m in zip(messages, _M)]))
        rising = levels[k].where("dir <> ''").select("repo_id", _parent(F.col("dir")).alias("dir"), *[F.col(m).alias(b) for m, b in zip(_M, _B)]).groupBy("repo_id", "dir").agg(*[F.sum(b).alias(b) for b in _B])
    known = levels[0].select("repo_id", "dir", *[(F.col(b) + math.log(p)).alias(b) for b, p in zip(_B, PRIOR)])
    beliefs = [scratch.keep(known)]
    for k in range(1, deepest + 1):
        above = beliefs[-1].select("repo_id", F.col("dir").alias("up"), *[F.col(b).alias(f"p{i}") for i, b in enumerate(_B)])
        met = skew_join(levels[k].withColumn("up", _parent(F.col("dir"))), above, ["repo_id", "up"])
        down = _pass([F.col(f"p{i}") - F.col(m) for i, m in enumerate(_M)], FOLDER_STAYS)
        beliefs.append(scratch.keep(met.select("repo_id", "dir", *[(F.col(b) + d).alias(b) for b, d in zip(_B, down)])))
    folders = beliefs[0]
    for x in beliefs[1:]:
        folders = folders.unionByName(x)
    folders = folders.select("repo_id", "dir", *[F.col(b).alias(f"p{i}") for i, b in enumerate(_B)])
    own = _pass([F.col(b) for b in _B], FILE_STAYS)
    met = skew_join(leaves.select("*", *[c.alias(m) for c, m in zip(own, _M)]), folders, ["repo_id", "dir"])
    down = _pass([F.col(f"p{i}") - F.col(m) for i, m in enumerate(_M)], FILE_STAYS)
    final = met.select("repo_id", "file_path", *[(F.col(b) + d).alias(b) for b, d in zip(_B, down)])
    best = F.greatest(*_B)
    label = F.lit(LABELS[4])
    for i in (3, 2, 1, 0):
        label = F.when(F.col(_B[i]) == best, LABELS[i]).otherwise(label)
    return final.select("repo_id", "file_path", label.alias("label"), (1 / sum((F.exp(F.col(b) - best) for b in _B), F.lit(0.0))).alias("certainty"))
