"""Information-theoretic sanitisation of personal data and secrets.

Protected entities (mail addresses, phone and card numbers, IP and bank numbers, credentials) are found by patterns with
checks (card check sums, octet ranges) and generalised to their class, ``[EMAIL]``. What is left may still disclose them: a
term ``t`` reveals a protected class ``c`` by the share of c's information that it carries,

    disclosure(t, c) = PMI(t; c) / IC(c),   PMI = log(p(c | t) / p(c)),   IC = -log p(c),

which is 1 if every document with t has c. The probabilities are corpus co-occurrence counts over all documents. As a
plug-in estimate would condemn every rare word of a document with an entity, p(c | t) is the lower Wilson bound at
``Z`` deviations, and its successes are distinct sets of entity values rather than documents, so copies of one document are one
observation, and documents that share one value among others are several. Terms at or over ``DISCLOSURE`` are sanitised in documents that hold the class: generalised to ``[SECRET TERM]``
if they reveal one class, removed if they reveal several. Documents without a protected entity have
nothing to protect and stay byte for byte.

Scale: one pass counts (term, class, value) in the few documents with entities; a second counts the candidate terms in all
documents, against a broadcast only while there are at most ``BROADCAST_TERMS`` candidates, else by a full term count and a
join with the same result. Shuffles carry partial counts. The terms to sanitise go to the executors as a table; a candidate needs
``MIN_VALUES`` distinct protected values and a high bound, so it stays a small part of the vocabulary, and its
size is checked: past ``BROADCAST_TERMS`` they are joined to the documents' own terms instead.

Defined results: null text stays null, empty text stays empty; a null doc_id and repeated rows are treated like any row (counts
are over rows); entities that overlap count once, the leftmost and longest-listed class first; a term exactly at the threshold is
sanitised; texts of any length are searched whole; without entities nothing changes; other columns pass unchanged, whatever they are
called; an empty table gives an empty table. Upper and lower case are told apart in one place only (``low``).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SpanHash, buffers, cut, equal_spans, fresh, lean, once, small_batches, steps, words

DISCLOSURE = 0.8
Z = 3.0
MIN_VALUES = 5
BROADCAST_TERMS = 500_000

_KEY = r"(?:api|access|auth|secret|private|client)?[_ -]?(?:token|secret|passw(?:or)?d|passwd|pwd|api[_ -]?key|access[_ -]?key|secret[_ -]?key)"
#: In order of precedence where two begin at the same place.
PATTERNS: dict[str, str] = {
    "EMAIL": r"(?<![\w.%+\-])[\w.%+\-]++@[\w\-]+(?:\.[\w\-]+)*\.[^\W\d_]{2,}",
    "SECRET": rf"(?i:(?<![^\W_]){_KEY}[ \t]*[=:][ \t]*(?:\"[^\"\n]{{4,}}\"|'[^'\n]{{4,}}'|[^\s\"'|,;]{{6,}}))"
    r"|(?<!\w)(?:AKIA|ASIA)[0-9A-Z]{16}(?!\w)|(?<!\w)gh[pousr]_(?=[A-Za-z]*\d)\w{30,}|(?<!\w)sk-(?=[A-Za-z\-_]*\d)[\w\-]{20,}|(?<!\w)eyJ(?=[A-Za-z_\-]*\d)[\w\-]+\.[\w\-]+\.[\w\-]+"
    r"|(?<!\w)(?=[0-9a-fA-F]*\d)[0-9a-fA-F]{32,}(?!\w)",
    "IBAN": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "CARD": r"(?<![\w.])\d(?:[ \-]?\d){12,18}(?![\w]|\.\d)",
    "IP": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)",
    "SSN": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "PHONE": r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)[ .\-]?)?\d{2,4}(?:[ .\-]?\d{2,4}){1,4}(?!\w)"
    r"|(?<!\w)\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\w)|(?<![\w.\-])\d{3}[.\-]\d{3}[.\-]\d{4}(?![\w\-])",
}
CLASSES = list(PATTERNS)
_ANY = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items()))
#: No pattern matches without one of these signs or crosses a line: other texts and lines aren't searched. Digits are those of any script.
_HINTED = re.compile(r"[\d@=:]|AKIA|ASIA")
_HINT, _BEYOND = r"[0-9@=:]|AKIA|ASIA", r"[^\x00-\x7F]"
_DIGIT = r"[\p{Nd}\x{11F50}-\x{11F59}\x{1E4F0}-\x{1E4F9}]"  # with those that a JVM may be too old to know
#: Terms are runs of ASCII letters and of anything beyond ASCII.
_WORD = re.compile("[A-Za-z\u0080-\U0010ffff]+")
_BLANK = np.array([not (chr(b).isalpha() or b > 127) for b in range(256)])


def _checked(kind: str, value: str) -> bool:
    if kind == "IP":
        return all(int(x) < 256 for x in value.split("."))
    if kind == "CARD":
        digits = [int(x) for x in value if x.isdigit()][::-1]
        return (sum(digits[::2]) + sum(sum(divmod(2 * x, 10)) for x in digits[1::2])) % 10 == 0
    return True


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, class) of protected entities, left to right."""
    found, at, search = [], 0, _ANY.search
    while hint := _HINTED.search(text, at):
        begin = text.rfind("\n", 0, hint.start()) + 1
        end = text.find("\n", hint.start())
        end = len(text) if end < 0 else end
        at = max(at, begin)
        while m := search(text, at, end):
            if _checked(m.lastgroup, m[0]):
                found.append((m.start(), m.end(), m.lastgroup))
                at = m.end()
            else:  # a longer match of one class may hide a shorter one of another
                at = m.start() + 1
        at = end
    return found


def masked(text: str, found: list[tuple[int, int, str]]) -> str:
    at, out = 0, []
    for start, end, _ in found:
        out += [text[at:start], " "]
        at = end
    return "".join(out) + text[at:]


@once
@F.arrow_udf(
    T.StructType([T.StructField("rest", T.StringType()), T.StructField("class", T.ArrayType(T.IntegerType())), T.StructField("value", T.ArrayType(T.LongType()))])
)
@lean
def protected(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The text without its entities in lower case, their classes, and for each class a hash of its set of values; null without entities."""
    kind = pa.struct([("rest", pa.string()), ("class", pa.list_(pa.int32())), ("value", pa.list_(pa.int64()))])
    for texts in batches:
        out = []
        for text in texts.to_pylist():
            found = entities(text) if text else []
            sets: dict[int, set[str]] = {}
            for start, end, name in found:
                sets.setdefault(CLASSES.index(name), set()).add(text[start:end])
            values = [xxhash.xxh64_intdigest("\n".join(sorted(v))) - (1 << 63) for v in sets.values()]  # no value crosses a line
            out.append({"rest": low(masked(text, found)), "class": list(sets), "value": values} if found else None)
        yield pa.array(out, kind)


def hinted(text: Column) -> Column:
    return F.when(text.rlike(_HINT) | (text.rlike(_BEYOND) & text.rlike(_DIGIT)), text)


def low(text: str) -> str:
    """Lower case that doesn't depend on what surrounds a word."""
    return text.lower().replace("\u03c2", "\u03c3")


@F.arrow_udf(T.StringType())
@lean
def lowered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        yield pa.array([None if t is None else low(t) for t in texts.to_pylist()], pa.string())


def terms(text: Column) -> Column:
    """Distinct terms of a text in lower case."""
    return F.array_distinct(F.filter(F.split(text, r"[\x00-@\[-`{-\x7f]+"), lambda w: w != ""))


def wilson(hits: Column, n: Column, z: float = Z) -> Column:
    """Lower bound of a share."""
    p = hits / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def term_counter(shared):
    """mapInArrow function over (text, hinted): in how many documents each candidate occurs, entities masked, by task.

    Words are hashed over the Arrow buffer, looked up among the candidates' hashes and confirmed by their bytes; no word becomes
    a Python string. ``shared`` is a broadcast of the candidates.
    """

    class Counter:
        def __init__(self, candidates: list[str]):
            self.data, self.offsets = buffers(pa.array(candidates, pa.string()))
            wanted = SpanHash(self.data).of(self.offsets[:-1], self.offsets[1:])
            self.order = np.argsort(wanted)
            self.wanted = wanted[self.order]
            self.size = np.diff(self.offsets)[self.order]
            self.total = np.zeros(len(wanted), np.int64)

        def add(self, texts: pa.Array) -> None:
            data, offsets = buffers(texts)
            n = len(self.wanted)
            for a, b in steps(offsets):
                own = data[offsets[a] : offsets[b]]
                start, end, first = words(own, offsets[a : b + 1] - offsets[a], _BLANK[own])
                h = SpanHash(own).of(start, end)
                at = np.minimum(np.searchsorted(self.wanted, h), n - 1)
                hit = np.flatnonzero((self.wanted[at] == h) & (self.size[at] == end - start))
                both = np.concatenate([own, self.data, np.zeros(8, np.uint8)])
                hit = hit[equal_spans(both, start[hit], len(own) + self.offsets[self.order[at[hit]]], end[hit] - start[hit])]
                row = np.searchsorted(first, hit, side="right") - 1
                pairs = np.unique(row * n + at[hit])
                self.total += np.bincount(pairs % n, minlength=n)

    @lean
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        candidates = shared.value
        counter = Counter(candidates)
        for batch in batches:
            texts = batch["text"].to_pylist()
            for i, text in enumerate(batch["hinted"].to_pylist()):
                if text is not None and (spans := entities(text)):
                    texts[i] = masked(text, spans)
            counter.add(pa.array([low(t) for t in texts], pa.large_string()))
        hit = np.flatnonzero(counter.total)
        names = [candidates[i] for i in counter.order[hit].tolist()]
        yield pa.RecordBatch.from_pydict({"term": names, "n": pa.array(counter.total[hit])}, schema=pa.schema([("term", pa.string()), ("n", pa.int64())]))

    return counted


def revealing_terms(docs: DataFrame, disclosure: float = DISCLOSURE, min_values: int = MIN_VALUES, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """(term, class, disclosure): terms that reveal a protected class at or over the threshold."""
    texts = docs.where("text is not null").select("text")
    total = texts.count()
    found = texts.select(hinted(F.col("text")).alias("text")).where("text is not null").select(protected(F.col("text")).alias("p"))
    held = found.where("p is not null").select("p.rest", F.explode(F.arrays_zip("p.class", "p.value")).alias("e")).select("rest", "e.class", "e.value")
    # few documents hold entities: cut, as classes and terms are counted from them
    held = cut(held)
    size = {r["class"]: r["count"] for r in held.groupBy("class").count().collect()}  # one row for each class
    size = {c: n for c, n in size.items() if n < total}
    if not size:
        return docs.sparkSession.createDataFrame([], "term string, class int, disclosure double")
    p = F.element_at(F.create_map(*[F.lit(x) for c, n in size.items() for x in (c, n / total)]), F.col("class"))
    pairs = held.where(F.col("class").isin(list(size))).select("class", "value", F.explode(terms(F.col("rest"))).alias("term"))
    met = pairs.groupBy("term", "class", "value").agg(F.count(F.lit(1)).alias("n")).groupBy("term", "class")
    met = met.agg(F.sum("n").alias("together"), F.count(F.lit(1)).alias("values")).where(F.col("values") >= min_values)
    # the bound if the term occurred nowhere else; what fails it now fails whatever the total count is
    most = wilson(F.col("values"), F.col("values").cast("double"))
    candidates = cut(met.where(1 - F.log(most) / F.log(p) >= disclosure))
    wanted = candidates.select("term").distinct()
    names = sorted(r[0] for r in wanted.limit(broadcast_terms + 1).toLocalIterator())
    if not names:
        return candidates.select("term", "class", F.lit(1.0).alias("disclosure"))
    if len(names) <= broadcast_terms:
        shared = docs.sparkSession.sparkContext.broadcast(names)
        counts = texts.select("text", hinted(F.col("text")).alias("hinted")).mapInArrow(term_counter(shared), "term string, n long")
        counts = counts.groupBy("term").agg(F.sum("n").alias("documents"))
    else:
        whole = texts.select("text", protected(hinted(F.col("text"))).alias("p"))
        every = whole.select(F.explode(terms(F.coalesce("p.rest", lowered(F.col("text"))))).alias("term"))
        counts = every.groupBy("term").agg(F.count(F.lit(1)).alias("documents")).join(wanted, "term", "left_semi")
    low = wilson(F.col("values"), (F.col("values") + F.col("documents") - F.col("together")).cast("double"))
    scored = candidates.join(counts, "term").select("term", "class", (1 - F.log(low) / F.log(p)).alias("disclosure"))
    return cut(scored.where(F.col("disclosure") >= disclosure))


def _replacer(revealing: dict[str, tuple[int, ...]]):
    def clean(text: str | None) -> tuple[str | None, int, int]:
        found = entities(text) if text else []
        if not found:
            return text, 0, 0
        held = {CLASSES.index(c) for _, _, c in found}
        hidden = 0

        def term(m: re.Match) -> str:
            nonlocal hidden
            classes = held.intersection(revealing.get(low(m[0]), ()))
            if not classes:
                return m[0]
            hidden += 1
            return f"[{CLASSES[min(classes)]} TERM]" if len(classes) == 1 else ""

        at, out = 0, []
        for start, end, name in found:
            out += [_WORD.sub(term, text[at:start]), f"[{name}]"]
            at = end
        out.append(_WORD.sub(term, text[at:]))
        return "".join(out), len(found), hidden

    return clean


_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_entities", T.IntegerType()), T.StructField("n_terms", T.IntegerType())])
_ARROW = pa.struct([("text", pa.string()), ("n_entities", pa.int32()), ("n_terms", pa.int32())])


def cleaner(docs: DataFrame, revealing: DataFrame):
    """Column function: (text, the document's own revealing terms or null) -> sanitised text and counts; null if clean."""
    table: dict[str, tuple[int, ...]] = {}
    for row in revealing.toLocalIterator():
        table[row["term"]] = (*table.get(row["term"], ()), row["class"])
    shared = docs.sparkSession.sparkContext.broadcast(table)

    @F.arrow_udf(_RESULT)
    @lean
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        one = _replacer(shared.value)
        for texts in batches:
            done = [one(t) for t in texts.to_pylist()]
            yield pa.array([{"text": t, "n_entities": e, "n_terms": h} if e else None for t, e, h in done], _ARROW)

    return clean


def _joined(docs: DataFrame, revealing: DataFrame, out: str) -> DataFrame:
    """``docs`` with column ``out``, where the terms are too many to broadcast: each document's own are joined to it."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row"))
    p = protected(hinted(F.col("doc.text")))
    own = rows.select("*", F.explode_outer(terms(F.when(p.isNotNull(), lowered(F.col("doc.text"))))).alias("term"))
    known = revealing.groupBy("term").agg(F.collect_set("class").alias("classes"))
    back = own.join(known, "term", "left").groupBy("row").agg(
        F.first("doc").alias("doc"), F.collect_list(F.when(F.col("classes").isNotNull(), F.struct("term", "classes"))).alias("known")
    )

    @F.arrow_udf(_RESULT)
    def clean(texts: pa.Array, known: pa.Array) -> pa.Array:
        done = []
        for text, mine in zip(texts.to_pylist(), known.to_pylist()):
            t, e, h = _replacer({x["term"]: tuple(x["classes"]) for x in mine})(text)
            done.append({"text": t, "n_entities": e, "n_terms": h} if e else None)
        return pa.array(done, _ARROW)

    cleaned = back.select("doc", clean(F.col("doc.text"), F.col("known")).alias("clean"))
    return cleaned.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns], F.col("clean").alias(out))


def _marked(docs: DataFrame, disclosure: float, broadcast_terms: int) -> tuple[DataFrame, str]:
    """``docs`` with one column more: (text, n_entities, n_terms), null where nothing changes; and its name."""
    small_batches(docs.sparkSession)
    (out,) = fresh(docs, "clean")
    revealing = revealing_terms(docs, disclosure, broadcast_terms=broadcast_terms)
    if revealing.count() > broadcast_terms:
        return _joined(docs, revealing, out), out
    return docs.withColumn(out, cleaner(docs, revealing)(hinted(F.col("text")))), out


def sanitised(docs: DataFrame, disclosure: float = DISCLOSURE, broadcast_terms: int = BROADCAST_TERMS) -> DataFrame:
    """``docs`` with the same rows and columns, and ``text`` sanitised."""
    marked, out = _marked(docs, disclosure, broadcast_terms)
    return marked.withColumn("text", F.coalesce(f"{out}.text", "text")).drop(out)


def report(docs: DataFrame, disclosure: float = DISCLOSURE) -> DataFrame:
    """(doc_id, text, n_entities, n_terms) of every document."""
    marked, out = _marked(docs.select("doc_id", "text"), disclosure, BROADCAST_TERMS)
    zero = F.lit(0)
    return marked.select(
        "doc_id", F.coalesce(f"{out}.text", "text").alias("text"), F.coalesce(f"{out}.n_entities", zero).alias("n_entities"), F.coalesce(f"{out}.n_terms", zero).alias("n_terms")
    )


def expected_disclosure(values: int, together: int, documents: int, holders: int, total: int, z: float = Z) -> float:
    """The same measure in plain Python, for tests."""
    n = values + documents - together
    p = values / n
    low = (p + z * z / (2 * n) - z * math.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    return 1 - math.log(low) / math.log(holders / total)


#: Mail addresses, by a pattern without the look-behind that SQL lacks.
MAILS_SQL = r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[\w.%+\-]+@[\w\-]+(?:\.[\w\-]+)*\.[a-zA-Z]{2,}')) AS BIGINT) AS mails FROM documents
"""
