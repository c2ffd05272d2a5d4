"""Personal data: patterns, and terms that reveal protected values by their co-occurrence.

Values that the patterns find are the protected entities. For a term that shares several documents
with an entity, the corpus tells how much it reveals: the pointwise mutual information of term and
entity, as a share of the entity's own information. (At 1 the term occurs in no other document than
the entity's.) It counts only where a likelihood-ratio test, corrected for the number of pairs of terms
and entities, says that they don't meet by chance. Terms beyond a threshold are generalised, those beyond
a second one removed, at each of their places in all documents.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema
from pyspark.sql.types import StructType

from tamis.llm.common import free_names, map_batches, row_keys, text_slices
from tamis.operators.skew import attach_by_key
from tamis.staging import stage_table

KINDS = ("email", "ip", "card", "phone", "term")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A number begins where no digit stands before it, so long runs of digits are read once.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGITS = re.compile(r"[^0-9]")
TERM = re.compile(r"[^\W\d_]{3,}")
# Documents in which term and entity must occur together.
SUPPORT = 2
GENERALISE, REMOVE = 0.8, 0.95
# Distinct terms that a task counts before it sends them, or remembers.
HELD_TERMS = 1_000_000
SENT_TERMS = 20_000  # in a batch
# Chance that any pair of a term and an entity, of all that are tested, counts though they are independent.
CHANCE = 0.05
# Tasks get the revealing terms themselves if they are so many at most (8 MB). Beyond that they get a
# filter of 16 bits and 6 hashes a term (0.1 % false), of 64 MB at most; the join behind it is exact.
EXACT_TERMS = 1_000_000
FILTER_BITS = 1 << 29
FILTER_HASHES = 6


def _luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[::2]) + sum(v * 2 - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns: leftmost, not overlapping within a kind, by kind and start."""
    out, end = [], 0
    at = text.find("@")
    while at >= 0:
        if at >= end:
            start = at
            while start > end and text[start - 1] in LOCAL:
                start -= 1
            domain = DOMAIN.match(text, at + 1) if start < at else None
            if domain:
                end = domain.end()
                out.append(("email", start, end))
        at = text.find("@", at + 1)
    for m in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-3:]) <= 255 for part in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = NOT_DIGITS.sub("", m[0])
        if 16 <= len(digits) <= 19 and _luhn(digits):
            out.append(("card", *m.span()))
    for m in PHONE.finditer(text):
        if 8 <= len(NOT_DIGITS.sub("", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return out


def _number(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode(), digest_size=8).digest(), "little", signed=True)


def _entity(kind: str, value: str) -> int:
    return _number(f"{kind}:{value.lower() if kind == 'email' else NOT_DIGITS.sub('.', value)}")


def outer_terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, int, int]]:
    """The terms, as they are written, that touch none of the spans, and their places."""
    edges, at = sorted((start, end) for _, start, end in spans), 0
    behind = 0  # the furthest end of the spans before ``at``
    for m in TERM.finditer(text):
        start, end = m.span()
        while at < len(edges) and edges[at][0] < end:
            behind = max(behind, edges[at][1])
            at += 1
        if behind <= start:
            yield m[0], start, end


_SPAN = "struct<kind: string, start: int, end: int>"
# A record is a document (with the terms around its entities if it has any) or a count of documents
# with a term. ``doc`` numbers the rows, repeated ones too.
_RECORD = (
    f"row_key long, row_key2 int, doc_id {{id}}, base array<{_SPAN}>, doc long, entities array<long>, "
    "terms array<long>, term long, docs long"
)


def _observed(docs: DataFrame) -> DataFrame:
    ddl = _RECORD.format(id=docs.schema["doc_id"].dataType.simpleString())
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def rows(number: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(number, f.type) for f in schema],
            schema=schema,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        first = TaskContext.get().partitionId() << 40

        def counted() -> Iterator[pa.RecordBatch]:
            for some in batched(counts.items(), SENT_TERMS):
                yield rows(len(some), term=[_number(t) for t, _ in some], docs=[n for _, n in some])

        for part in text_slices(batches, "text"):
            base, entities, terms = [], [], []
            for text in part["text"].to_pylist():
                text = text or ""
                spans = base_spans(text)
                words = {w for w, _, _ in outer_terms(text, spans)} if spans else set(TERM.findall(text))
                words = {w.lower() for w in words}
                counts.update(words)
                base.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                entities.append(list({_entity(k, text[s:e]) for k, s, e in spans}))
                terms.append([_number(w) for w in words] if spans else [])
            yield rows(
                len(base), row_key=part["row_key"].to_pylist(), row_key2=part["row_key2"].to_pylist(),
                doc_id=part["doc_id"].combine_chunks(), base=base, doc=range(first, first + len(base)),
                entities=entities, terms=terms,
            )
            first += len(base)
            if len(counts) > HELD_TERMS:
                yield from counted()
                counts.clear()
        yield from counted()

    return map_batches(docs, run, from_arrow_schema(schema))


def _unlikely(total: int, tested: int, chance: float) -> Column:
    """Whether n_both of the n_term documents with a term would hardly fall on the entity's by chance.

    The logarithm of the likelihood ratio bounds the chance from above (Chernoff); it must be below
    ``chance`` divided by the number of pairs tested.
    """
    own, base = F.col("n_both") / F.col("n_term"), F.col("n_entity") / F.lit(float(max(total, 1)))
    rest = F.when(F.col("n_both") < F.col("n_term"), (1 - own) * F.log((1 - own) / (1 - base))).otherwise(0.0)
    evidence = F.col("n_term") * (own * F.log(own / base) + rest)
    return (own > base) & (evidence >= math.log(max(tested, 1) / chance))


def _revealing(seen: DataFrame, total: int, support: int, generalise: float, chance: float) -> DataFrame:
    """term, n_term, share: the terms that reveal an entity, with the largest share."""
    entities = stage_table(
        seen.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("n_entity"))
        .where((F.col("n_entity") >= support) & (F.col("n_entity") < total)),
        "entities",
    )
    counts = stage_table(
        seen.where(F.col("docs").isNotNull()).groupBy("term").agg(F.sum("docs").alias("n_term"))
        .where(F.col("n_term") >= support),
        "counts",
    )
    tested = counts.count() * entities.count()
    own = F.log(F.lit(float(max(total, 1))) / F.col("n_entity"))
    # As n_both <= n_entity, a term of more documents cannot have the share; the rest is for rounding.
    most = F.col("n_entity") * F.exp(own * F.lit(1.0 - generalise)) * F.lit(1.000001)
    holders = attach_by_key(
        seen.select("doc", F.explode("entities").alias("entity")), entities, "entity", "n_entity", "doc"
    ).where(F.col("n_entity").isNotNull())
    holders = stage_table(holders.withColumn("most", most), "holders")
    widest = holders.groupBy("doc").agg(F.max("most").alias("widest"))
    beside = seen.where(F.size("entities") > 0).select("doc", "terms").join(widest, "doc").select(
        "doc", "widest", F.explode("terms").alias("term")
    )
    beside = attach_by_key(beside, counts, "term", "n_term", "doc").where(F.col("n_term") <= F.col("widest"))
    together = (
        beside.join(holders, "doc").where(F.col("n_term") <= F.col("most"))
        .groupBy("entity", "term", "n_entity", "n_term").agg(F.count("*").alias("n_both"))
        .where(F.col("n_both") >= support)
    )
    lift = F.log(F.col("n_both") * F.lit(float(total)) / (F.col("n_term") * F.col("n_entity")))
    shares = together.where(_unlikely(total, tested, chance)).withColumn("share", F.least(F.lit(1.0), lift / own))
    shares = shares.where(F.col("share") >= generalise)
    return stage_table(shares.groupBy("term", "n_term").agg(F.max("share").alias("share")), "revealing")


def _filter(revealing: DataFrame, number: int) -> Callable[[int], bool]:
    """Tells, in tasks, whether a term may be a revealing one."""
    if number <= EXACT_TERMS:
        terms = np.sort(revealing.select("term").toArrow()["term"].to_numpy())

        def exact(term: int) -> bool:
            at = int(np.searchsorted(terms, term))
            return at < len(terms) and int(terms[at]) == term

        return exact
    bits = min(FILTER_BITS, 1 << (16 * number - 1).bit_length())
    low, high = F.col("term").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("term", 32).bitwiseOR(F.lit(1))
    places = F.array(*[(low + n * high).bitwiseAND(F.lit(bits - 1)) for n in range(FILTER_HASHES)])
    at = F.col("at")
    words = revealing.select(F.explode(places).alias("at")).groupBy(F.shiftright(at, 6).cast("int").alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))).alias("set")
    ).toArrow()
    map_of = np.zeros(bits // 64, "<i8")
    map_of[words["word"].to_numpy()] = words["set"].to_numpy()
    held = map_of.tobytes()

    def likely(term: int) -> bool:
        low, high = term & 0xFFFFFFFF, (term >> 32 & 0xFFFFFFFF) | 1
        at = [(low + n * high) & (bits - 1) for n in range(FILTER_HASHES)]
        return all(held[x >> 3] >> (x & 7) & 1 for x in at)

    return likely


def _places(docs: DataFrame, revealing: DataFrame, number: int) -> DataFrame:
    """row_key, row_key2, term, start, end of each place of a revealing term, and maybe of a few others."""
    wanted = _filter(revealing, number)
    ddl = "row_key long, row_key2 int, term long, start int, end int"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int | None] = {}

        def term(word: str) -> int | None:
            n = _number(word.lower())
            known[word] = n if wanted(n) else None
            return known[word]

        for part in text_slices(batches, "text"):
            found = []
            columns = (part[c].to_pylist() for c in ("row_key", "row_key2", "text"))
            for key, key2, text in zip(*columns, strict=True):
                words = set(TERM.findall(text or ""))
                terms = {w: n for w in words if (n := known[w] if w in known else term(w)) is not None}
                if terms:
                    for word, start, end in outer_terms(text, base_spans(text)):
                        if word in terms:
                            found.append((key, key2, terms[word], start, end))
                if len(known) > HELD_TERMS:
                    known.clear()
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema
                )

    return map_batches(docs.select("row_key", "row_key2", "text"), run, ddl)


def personal_spans(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    support: int = SUPPORT, generalise: float = GENERALISE, chance: float = CHANCE,
) -> DataFrame:
    """Per row: row_key, row_key2, doc_id, base and terms (arrays of spans).

    ``base`` has the spans of the patterns, by kind (email, ip, card, phone) and start; ``terms`` those
    of revealing terms, with ``share``, how much of an entity's information they reveal at most. Places
    are code points, ends exclusive. A term counts if it shares at least ``support`` documents with the
    same entity, and more than chance gives: over all pairs of a term and an entity of ``support`` documents
    or more, one that is independent passes with a probability of ``chance`` at most. Then all its places outside of ``base`` are spans, in documents without the entity too.

    Null and empty texts have no spans. Repeated rows count as documents of their own and get equal
    spans; null ids are kept; other columns are not read. No rows give no rows.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *row_keys(doc_id, text))
    seen = stage_table(_observed(docs), "observed")
    rows = seen.where(F.col("base").isNotNull()).select("row_key", "row_key2", "doc_id", "base")
    keys = ["row_key", "row_key2"]
    nothing = F.array().cast("array<struct<start: int, end: int, share: double>>")
    revealing = _revealing(seen, rows.count(), support, generalise, chance)
    number = revealing.count()
    if not number:
        return rows.withColumn("terms", nothing)
    # Repeated rows first become one, so no row key is a hot one.
    places = _places(docs, revealing, number).distinct()
    spans = (
        attach_by_key(places, revealing, "term", "n_term", F.struct(*keys, "start"))
        .where(F.col("share").isNotNull()).groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct("start", "end", "share"))).alias("terms"))
    )
    return rows.join(spans, keys, "left").withColumn("terms", F.coalesce("terms", nothing))


def sanitise(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", remove: float = REMOVE, **options
) -> DataFrame:
    """The documents with personal data taken out of their texts; all rows and columns stay.

    A pattern's span becomes its kind in brackets, a revealing term "[term]", or nothing where it
    reveals at least ``remove``. Where spans overlap, the first one (then the longest) gives the name
    for all of them. Options and edge cases: see personal_spans.
    """
    found = personal_spans(docs, doc_id, text, **options).where((F.size("base") > 0) | (F.size("terms") > 0))
    own, own2, k, k2, base_spans_of, terms_of = free_names(docs, "row_key", "row_key2", "k", "k2", "base", "terms")
    found = found.select(
        F.col("row_key").alias(k), F.col("row_key2").alias(k2), F.col("base").alias(base_spans_of),
        F.col("terms").alias(terms_of),
    ).dropDuplicates([k, k2])
    key, key2 = row_keys(doc_id, text)
    marked = docs.withColumn(own, key).withColumn(own2, key2).join(
        found, (F.col(own) == F.col(k)) & (F.col(own2) == F.col(k2)), "left"
    )
    at = docs.columns.index(text)
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = to_arrow_schema(fields)
        for part in text_slices(batches, at):
            batch = part.combine_chunks().to_batches()[0]
            base, terms = batch.column(base_spans_of), batch.column(terms_of)
            hit = base.is_valid()
            texts = batch.column(at)
            if hit.true_count:
                values = texts.to_pylist()
                for i in range(len(values)):
                    if hit[i].as_py():
                        spans = [(s["start"], s["end"], f"[{s['kind']}]") for s in base[i].as_py()]
                        spans += [
                            (s["start"], s["end"], "" if s["share"] >= remove else "[term]") for s in terms[i].as_py()
                        ]
                        values[i] = replaced(values[i], spans)
                texts = pa.array(values, schema.field(at).type)
            columns = [texts if n == at else batch.column(n).cast(schema.field(n).type) for n in range(len(schema))]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return map_batches(marked.select(*[F.col(f"`{c}`") for c in docs.columns], base_spans_of, terms_of), run, fields)


def replaced(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Put each span's name in its place; overlapping spans are one."""
    out, end = [], 0
    for start, stop, name in sorted(spans, key=lambda s: (s[0], -s[1])):
        if start >= end:
            out += [text[end:start], name]
        end = max(end, stop)
    return "".join([*out, text[end:]])
