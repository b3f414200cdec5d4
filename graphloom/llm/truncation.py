"""Text cut off by field limits or broken transfers.

Near-copies are found by min-hash banding and, cut anywhere, by the words
before their end; they are aligned and verified by the similarity (0.8 or more
of the five-word shingles) of the text to the beginning it is aligned with; the
copy whose alignment ends early is cut. All other texts are scored by how they end: a
mark of a cut, an open structure, a length at which their source's texts pile
up, and how readily the closing word closes a sentence anywhere in the corpus."""

from __future__ import annotations

import collections
import functools
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import Scratch, checked_broadcast, skew_join
from .minhash import ANCHOR, Hashes, band_links, beginning_links, chunks, shingle_set, words_of

#: Similarity of near-copies.
SIMILAR = 0.8
#: A closing word closes when at least this share of its other uses close, of at least CLOSE_USES.
CLOSES, CLOSE_USES = 0.04, 2
#: A word that is hardly used but at the end of texts (INNER of its uses elsewhere at most) is the beginning of one that comes LONGER times as often.
INNER, LONGER = 0.1, 4
#: A length is a limit when so many unfinished texts have it, and so many times the neighbouring lengths' mean.
PILE, PILE_TIMES, PILE_SPAN = 3, 8.0, 20

_MARK = re.compile(r"(?:[\[(<{]\s*(?:\w+\s+){0,2}(?:truncated|clipped|cut(?: off)?|snip(?:ped)?|shortened|abridged)\b[^\])>}\n]{0,20}[\])>}]|�)$", re.I)
_DOTS = re.compile(r"(?:…|\.\.\.)\s*$")
_TERMINAL = ".!?。！？"
_SIGNS = ")]}|`\"'»”>;"


def _open_brackets(line: str) -> bool:
    depth = {"(": 0, "[": 0, "{": 0}
    shut = {")": "(", "]": "[", "}": "{"}
    for c in line:
        if c in depth:
            depth[c] += 1
        elif c in shut:
            depth[shut[c]] = max(0, depth[shut[c]] - 1)
    return any(depth.values())


def ending(text: str) -> str:
    """How a text ends: mark, ellipsis, open, done, sign or word.

    mark: says that it was cut. open: within a code span, a code block, a
    string or brackets. done: ends as finished sentences do. sign: ends on a
    closing sign without a sentence's end before it, as finished and cut texts
    can. word: ends on a bare word or an unfinishing sign. A blank text is done."""
    t = text.rstrip()
    if not t:
        return "done"
    if _MARK.search(t):
        return "mark"
    last = t[-1]
    line = t[t.rfind("\n") + 1 :]
    ticks = line.replace("```", "")
    if t.endswith(("…", "...")):
        return "ellipsis"
    if ticks.count("`") % 2 and not line.startswith("```"):
        return "open"
    if last in _TERMINAL or t.endswith("```"):
        return "done"
    in_block = t.count("```") % 2 == 1
    if in_block or _open_brackets(line) or re.search(r'\{.*"', line) and line.count('"') % 2:
        return "open"
    if last in _SIGNS:
        return "done" if t.rstrip(_SIGNS)[-1:] in tuple(_TERMINAL) else "sign"
    if unicodedata.category(last) in ("So", "Sk", "Cf", "Mn"):
        return "done"
    return "word"


_LINE_END = re.compile(r"\r\n|\r|\n")
_GAPS = re.compile("[ \\t\u00a0\u3000]+")
_TRAIL = re.compile(r"[ \t\n\x0b\f\r]+$")
_SENTENCE = re.compile(r"[.!?。！？…:;][\"'`)\]]*$")
_SHELL = regex.compile(r"^[^\p{L}0#@]+|[^\p{L}0]+$")
_MARKED = "\u0001"


def tokens(text: str) -> list[str]:
    """Words of a text with a mark where a line ends."""
    t = re.sub("([。！？])", r"\1 ", _LINE_END.sub(f" {_MARKED} ", _TRAIL.sub("", text)))
    return [w for w in _GAPS.split(t) if w]


@functools.lru_cache(maxsize=200_000)
def plain(word: str) -> str:
    """A word without case, digits' values and surrounding signs."""
    return _SHELL.sub("", re.sub(r"[0-9]+", "0", word)).lower()


@functools.lru_cache(maxsize=200_000)
def _closes_sentence(word: str) -> bool:
    return bool(_SENTENCE.search(word))


def _features(batches):
    """tid, kind, word, n, words, before, closing, near, bands of each text."""
    for batch in batches:
        tids, texts = batch.column("tid"), batch.column("text").to_pylist()
        for a, b in chunks(texts):
            part = texts[a:b]
            h = Hashes([words_of(t) for t in part])
            ends = pa.array(np.concatenate([[0], np.cumsum(h.count)]), pa.int32())
            listed = lambda v, t: pa.ListArray.from_arrays(ends, pa.array(v, t))
            last = [(tokens(_DOTS.sub("", t)) or [""])[-1] for t in part]
            bands = h.bands()
            steps = pa.array(np.arange(0, bands.size + 1, bands.shape[1]), pa.int32())
            columns = [
                tids.slice(a, b - a),
                pa.array([ending(t) for t in part], pa.string()),
                pa.array([plain(w) for w in last], pa.string()),
                pa.array(h.count, pa.int32()),
                listed(h.flat, pa.string()),
                listed(h.before(), pa.int64()),
                listed(h.closing(), pa.int64()),
                listed(h.closing(ANCHOR), pa.int64()),
                pa.ListArray.from_arrays(steps, pa.array(bands.ravel(), pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["tid", "kind", "word", "n", "words", "before", "closing", "near", "bands"])


_FEATURES = "tid long, kind string, word string, n int, words array<string>, before array<long>, closing array<long>, near array<long>, bands array<long>"


def _last_word(text: str) -> str:
    """The word a text ends with, without a mark of a cut after it."""
    t = text.rstrip()
    mark = _MARK.search(t)
    return plain((tokens(t[: mark.start()] if mark else _DOTS.sub("", t)) or [""])[-1])


def _word_counts(batches):
    """word, uses, closing, ends of each batch of texts."""
    for batch in batches:
        uses: collections.Counter = collections.Counter()
        closing: collections.Counter = collections.Counter()
        ends: collections.Counter = collections.Counter()
        for text in batch.column("text").to_pylist():
            found = tokens(text)
            if word := _last_word(text):
                ends[word] += 1
            for i, x in enumerate(found):
                word = plain(x)
                if word:
                    uses[word] += 1
                    if i + 1 == len(found) or found[i + 1] == _MARKED or _closes_sentence(x):
                        closing[word] += 1
        words = list(uses | ends)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *(pa.array([n[w] for w in words], pa.int64()) for n in (uses, closing, ends))], ["word", "uses", "closing", "ends"])


def word_uses(texts: DataFrame) -> DataFrame:
    """word, uses, closing, ends: how often each word of the corpus comes, how
    often it closes a sentence, a line or a text, and how many texts end with it,
    be it before a mark of a cut. Every copy of a text counts once; each batch is
    counted before the shuffle."""
    counts = texts.select("text").mapInArrow(_word_counts, "word string, uses long, closing long, ends long")
    return counts.groupBy("word").agg(F.sum("uses").alias("uses"), F.sum("closing").alias("closing"), F.sum("ends").alias("ends"))


def _sizes() -> Column:
    """A text's lengths by unit. Bytes count only where they differ from the
    characters; there a cut can leave up to two bytes of a character unused."""
    multi = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.lit("bytes").alias("unit"), (F.col("bytes") + i).alias("size")))
    chars = F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")))
    return F.when(F.col("bytes") > F.col("chars"), F.concat(chars, multi)).otherwise(chars)


def length_limits(ends: DataFrame) -> DataFrame:
    """source, unit (chars or bytes), size: the lengths at which the
    unfinished texts of a source pile up."""
    sizes = ends.where("kind in ('word', 'open', 'ellipsis', 'mark')").select("source", F.explode(_sizes()).alias("s")).select("source", "s.*")
    counts = sizes.groupBy("source", "unit", "size").agg(F.count(F.lit(1)).alias("n"))
    near = counts.select("source", "unit", F.explode(F.sequence(F.col("size") - PILE_SPAN, F.col("size") + PILE_SPAN)).alias("size"), F.col("n").alias("m"))
    around = near.groupBy("source", "unit", "size").agg(F.sum("m").alias("m"))
    dense = (F.col("m") - F.col("n")) / (2 * PILE_SPAN)
    return counts.join(around, ["source", "unit", "size"]).where((F.col("n") >= PILE) & (F.col("n") >= PILE_TIMES * dense)).select("source", "unit", "size")


def goes_on(text: str, hub: str) -> bool | None:
    """Whether hub is a near-copy of text that goes on where text ends: the
    last whole words of text are sought in hub, at any place, and the beginning
    of hub up to there must be similar to the whole text. True if
    hub goes on within the word, False if after it, None if it does not."""
    p, q = words_of(text), words_of(hub)
    anchor = p[-1 - ANCHOR : -1]
    if not anchor:
        return None
    places = [i + len(anchor) for i in range(len(q) - len(anchor)) if q[i : i + len(anchor)] == anchor and q[i + len(anchor)].startswith(p[-1])]
    found, x = None, None
    for at in sorted(places, key=lambda i: abs(i - len(p) + 1)):
        more = len(q[at]) > len(p[-1])
        if not more and at + 1 == len(q):
            continue
        x = shingle_set(p) if x is None else x
        y = shingle_set([*q[:at], p[-1]])
        both = len(np.intersect1d(x, y, assume_unique=True))
        if both < SIMILAR * (len(x) + len(y) - both):
            continue
        if more and q[at][len(p[-1])].isalnum():
            return True
        found = False
    return found


def _align(batches):
    for batch in batches:
        found = [(t, g) for t, a, b in zip(batch.column("tid").to_pylist(), batch.column("text").to_pylist(), batch.column("hub_text").to_pylist()) if (g := goes_on(a, b)) is not None]
        yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in found], pa.int64()), pa.array([g for _, g in found], pa.bool_())], ["tid", "mid_word"])


def cut_texts(documents: DataFrame) -> DataFrame:
    """doc_id, source, reason of each document whose text was cut.

    reason: mark, copy (a near-copy goes on), limit (unfinished or after a closing
    sign at a length limit of its source), open, partial (ends within a word) or closing (ends
    on a word that does not close). Null, empty and blank texts are never cut.
    Copies of one text share one verdict except for the limit, which is per
    source; a null source is a source of its own. A repeated doc_id gives one
    row. Whole texts are read; all counts run over the whole corpus."""
    scratch = Scratch(documents.sparkSession, "truncation")
    some = documents.where("doc_id is not null and text is not null").where(F.col("text").rlike(r"\S")).select("doc_id", F.coalesce("source", F.lit("")).alias("source"), "text", F.sha2("text", 256).alias("key"))
    texts = scratch.keep(some.groupBy("key").agg(F.min("doc_id").alias("tid"), F.first("text").alias("text")))
    docs = some.groupBy("doc_id").agg(F.min(F.struct("source", "key")).alias("d")).select("doc_id", "d.*")
    made = scratch.keep(texts.select("tid", "text").mapInArrow(_features, _FEATURES))
    sized = texts.select("key", "tid", F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    judged = scratch.keep(sized.join(made.select("tid", "kind", "word"), "tid"))
    ends = scratch.keep(skew_join(docs, judged, ["key"]))
    uses = scratch.keep(word_uses(texts))
    limits = checked_broadcast(length_limits(ends).withColumn("at_limit", F.lit(True)))
    final = judged.where("kind in ('word', 'ellipsis')").select("word").distinct()
    begins = uses.where(F.length("word") > 1).select(
        F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring("word", F.lit(1), i))).alias("word"), F.col("uses").alias("longer")
    )
    longer = begins.join(final, "word", "left_semi").groupBy("word").agg(F.max("longer").alias("longer"))
    words = final.join(uses, "word", "left").join(longer, "word", "left")

    links = scratch.keep(band_links(made, scratch).unionByName(beginning_links(made, scratch)).distinct(), free=True)
    pairs = skew_join(links, texts.select(F.col("tid").alias("hub"), F.col("text").alias("hub_text")), ["hub"]).join(texts.select("tid", "text"), "tid")
    copies = pairs.select("tid", "text", "hub_text").mapInArrow(_align, "tid long, mid_word boolean").groupBy("tid").agg(F.max("mid_word").alias("mid_word"))

    u, c = F.coalesce("uses", F.lit(0)) - 1, F.coalesce("closing", F.lit(0)) - 1
    # all shares, so that a beginning of a word stays one however often the corpus cuts it
    uses_, ends_ = F.coalesce("uses", F.lit(0)), F.coalesce("ends", F.lit(0))
    partial = (u <= 0) | ((uses_ - ends_ <= INNER * uses_) & (F.coalesce("longer", F.lit(0)) >= LONGER * ends_))
    closes = (c >= CLOSE_USES) & (c >= CLOSES * u)
    verdicts = skew_join(judged.select("tid", "key", "kind", "word"), words, ["word"], "left").join(copies, "tid", "left").select(
        "key",
        F.when(F.col("kind") == "mark", "mark")
        .when(F.col("mid_word") | (F.col("mid_word").isNotNull() & F.col("kind").isin("word", "open", "ellipsis", "sign")), "copy")
        .when(F.col("kind") == "open", "open")
        .when(F.col("kind").isin("word", "ellipsis") & (F.col("word") != "") & partial, "partial")
        .when((F.col("kind") == "word") & ~closes | (F.col("kind") == "ellipsis") & (c < CLOSES * u), "closing")
        .alias("reason"),
    )
    at_limit = ends.where("kind in ('word', 'ellipsis', 'sign')").select("doc_id", "source", F.explode(_sizes()).alias("s")).select("doc_id", "source", "s.*")
    at_limit = at_limit.join(limits, ["source", "unit", "size"]).select("doc_id").distinct().withColumn("lim", F.lit("limit"))
    out = skew_join(ends.select("doc_id", "source", "key"), verdicts, ["key"]).join(at_limit, "doc_id", "left")
    return out.select("doc_id", "source", F.coalesce("reason", "lim").alias("reason")).where("reason is not null")


def cut_rates(documents: DataFrame) -> DataFrame:
    """source, n_docs, n_cut, share: how often each source cuts its texts.
    A null source is reported as ''."""
    cut = cut_texts(documents).groupBy("source").agg(F.count(F.lit(1)).alias("n_cut"))
    total = documents.groupBy(F.coalesce("source", F.lit("")).alias("source")).agg(F.count_distinct("doc_id").alias("n_docs"))
    return total.join(cut, "source", "left").select("source", "n_docs", F.coalesce("n_cut", F.lit(0)).cast("long").alias("n_cut"), (F.coalesce("n_cut", F.lit(0)) / F.col("n_docs")).alias("share"))
