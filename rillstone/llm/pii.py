"""Operator 6, personal data: base patterns seed a bootstrapped extraction by context."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import durable, numbered, scratch, sized_join, spare_name, text_slices

KINDS = ("email", "ip", "card", "phone")
#: Lexical patterns look at so many characters on either side of an identifier, within its line.
CONTEXT_CHARS = 48
#: The levels of patterns, the most special first, and from how many different seeds each is trusted for a
#: kind: two words before; a word before and one after; a word before and the identifier's shape; one
#: word before; one word after. Vaguer ones need more.
LEVELS = {"two": 3, "around": 3, "shape": 5, "before": 6, "after": 6}
#: ... and the seeds of a pattern of another level than the first must have so many different words on
#: their other side (counted in 64 slots by hash), or they are but one phrase.
LEAST_WORDS = 3
#: ... and from what confidence.
LEAST_CONFIDENCE = 0.8
#: Rounds of scoring, and how often the instances found become seeds.
ROUNDS = 3
BOOTSTRAPS = 3

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_LETTERS = re.compile(r"[^\W\d_]+")
_WORDS = re.compile(r"[^\W\d_]+|[=:#]")
_MARK = re.compile(r"[0-9@]|(?<=\w)[._](?=\w)|(?<=\w)(?=\x20?[\[({](?:at|dot|@)[\])}])|(?<=\w)(?=\x20at\x20[\w-]+\x20dot\x20\w)", re.I)
#: What joins the parts of an address, and the next group of digits.
_AT_DOT = re.compile(r"\x20?[\[({](?:at|dot|@)[\])}]\x20?(?=\w)|\x20at\x20(?=[\w-]+\x20dot\x20\w)|\x20dot\x20(?=\w)", re.I)
_GROUP = re.compile(r"[)\]]?(?:\x20-\x20|[\x20\xa0-])?[(\[]?[0-9][0-9.-]*(?<=[0-9])(?![^\W_])")
_PAIRS = {"(": ")", "[": "]"}
_EDGE = frozenset(" \t\n\r\x0b\x0c\"'()[]{}<>,;|&$%*")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of the base patterns' matches, sorted; code points, end exclusive.

    Each kind is matched leftmost and non-overlapping in time linear in the text: e-mails from
    their at-signs, addresses from maximal chains of numbers and dots, four numbers at a time.
    """
    found = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    if _DIGIT.search(text):
        for m in _CHAIN.finditer(text):
            if m.group().count(".") < 3:
                continue
            parts, at = m.group().split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = at + sum(map(len, four)) + 3
                if all(map(_small, four)):
                    found.append((at, 1, end))
                at = end + 1
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        for m in _PHONE.finditer(text) if "+" in text else ():
            if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                found.append((m.start(), 3, m.end()))
    return sorted(found)


def shape(value: str) -> str:
    """The classes of a token's characters, each run once: 9 for digits, a for letters, signs as they are, at most 24."""
    return _DIGITS.sub("9", _LETTERS.sub("a", value))[:24]


def contexts(text: str, start: int, end: int, chars: int = CONTEXT_CHARS) -> list[tuple[str, str]]:
    """The lexical patterns around an identifier, one of each level that the line has the words for,
    each with a word on the identifier's other side that isn't part of it."""
    before = _WORDS.findall(text[max(0, start - chars) : start].rpartition("\n")[2].lower())
    after = _WORDS.search(text[end : end + chars].partition("\n")[0].lower())
    last, other = before[-1] if before else "", before[-2] if len(before) > 1 else ""
    out = []
    if other:
        out.append((f"two {other} {last}", ""))
    if before and after:
        out.append((f"around {last} {after.group()}", other))
    if before:
        out += [(f"shape {last} {shape(text[start:end])}", other), (f"before {last}", other)]
    if after:
        out.append((f"after {after.group()}", last))
    return out


def _run(text: str, start: int, at: int) -> tuple[int, int]:
    """The token around a place, not before ``at``, without signs at its end."""
    end = start
    while start > at and text[start - 1] not in _EDGE:
        start -= 1
    while end < len(text) and text[end] not in _EDGE:
        end += 1
    while end > start and not text[end - 1].isalnum():
        end -= 1
    return start, end


def identifiers(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Whole identifiers of any length that overlap no taken span, in time linear in the text.

    A token is one if it has a digit, an at-sign or an inner point or underscore; a bare word is
    none. Groups of digits that blanks, brackets or hyphens join are one identifier, as are the
    parts of an address around a written ``[at]``, ``(dot)`` or ``at ... dot``.
    """
    out, at, spans = [], 0, iter([*sorted((s, e) for s, _, e in taken), (len(text) + 1, len(text) + 1)])
    span = next(spans)
    while m := _MARK.search(text, at):
        while span[1] <= m.start():
            span = next(spans)
        if span[0] <= m.start():
            at = span[1]
            continue
        start, end = _run(text, m.start(), at)
        end = max(end, m.end())
        while j := _AT_DOT.match(text, end) or (_GROUP.match(text, end) if text[end - 1].isdigit() else None):
            stop = _run(text, j.end(), j.end())[1] if j.re is _AT_DOT else j.end()
            if stop <= end or j.end() > span[0] or stop > span[0]:
                break
            end = stop
        if start > at and text[start - 1] in _PAIRS and _PAIRS[text[start - 1]] in text[start:end]:
            start -= 1
        if end <= span[0] and any(c.isalnum() for c in text[start:end]):
            out.append((start, end))
        at = max(end, m.start() + 1)
    return out


def _extractor(chars):
    def run(batches):
        for batch in text_slices(batches):
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                found = base_spans(text)
                seen = [{"start": s, "end": e, "kind": KINDS[k], "contexts": [dict(zip(("context", "other"), x, strict=True)) for x in contexts(text, s, e, chars)], "value": text[s:e]} for s, k, e in found]
                seen += [{"start": s, "end": e, "kind": None, "contexts": [dict(zip(("context", "other"), x, strict=True)) for x in contexts(text, s, e, chars)], "value": text[s:e]} for s, e in identifiers(text, found)]
                rows.append(seen)
            yield pa.RecordBatch.from_arrays([batch.column("_row"), batch.column("doc_id"), pa.array(rows, _SEEN)], ["_row", "doc_id", "seen"])

    return run


_SEEN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("contexts", pa.list_(pa.struct([("context", pa.string()), ("other", pa.string())]))), ("value", pa.string())]))
_SEEN_SQL = "array<struct<start:long,end:long,kind:string,contexts:array<struct<context:string,other:string>>,value:string>>"


def _needed(levels: dict[str, int]):
    level = F.substring_index("context", " ", 1)
    return F.coalesce(*(F.when(level == k, F.lit(n)) for k, n in levels.items()), F.lit(max(levels.values())))


def _scored(edges: DataFrame, rounds: int, levels: dict[str, int], least_confidence: float, least_words: int) -> DataFrame:
    """context, kind, confidence of the patterns that the seeds of the graph make trusted."""
    has_digit = F.col("value").rlike("[0-9]")
    slot = F.expr("shiftleft(1L, cast(pmod(xxhash64(other), 64) as int))")
    sizes = edges.groupBy("context").agg(
        F.count(F.lit(1)).alias("every"),
        F.count_if(has_digit).alias("with_digit"),
        *(F.count_if(F.col("seed") == k).alias(f"seeds_{k}") for k in KINDS),
        *(F.bit_count(F.bit_or(F.when(F.col("seed") == k, slot))).alias(f"words_{k}") for k in KINDS),
    )
    able = durable(sizes.where(F.greatest(*(F.col(f"seeds_{k}") for k in KINDS)) >= _needed(levels)))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(f"seeds_{k}").alias("seeds"), F.col(f"words_{k}").alias("words"), F.col("every" if k == "email" else "with_digit").alias("instances")) for k in KINDS)))
    first = F.col("context").startswith(f"{next(iter(levels))} ")
    patterns = able.select("context", kinds.alias("k")).select("context", "k.*").where((F.col("seeds") >= _needed(levels)) & (first | (F.col("words") >= least_words))).drop("words")
    open_ends = durable(edges.where(F.col("seed").isNull()).join(able.select("context"), "context", "left_semi").select("context", "value"))
    confidence = patterns.withColumn("confidence", F.col("seeds") / F.col("instances"))
    fits = (F.col("kind") == "email") | has_digit
    for _ in range(rounds):
        guessed = (
            open_ends.join(confidence.select("context", "kind", "confidence"), "context").where(fits)
            .groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-9)))))).alias("score"))
        )
        gained = open_ends.join(guessed, "value").groupBy("context", "kind").agg(F.sum("score").alias("gain"))
        confidence = durable(
            patterns.join(gained, ["context", "kind"], "left").withColumn("confidence", (F.col("seeds") + F.coalesce("gain", F.lit(0.0))) / F.col("instances")).select("context", "kind", "seeds", "instances", "confidence")
        )
    # what the seeds alone support must reach half the threshold, so that guesses don't lift one another
    return confidence.where((F.col("confidence") >= least_confidence) & (F.col("seeds") / F.col("instances") >= least_confidence / 2)).select("context", "kind", "confidence")


def trusted_patterns(seen: DataFrame, rounds: int = ROUNDS, levels: dict[str, int] = LEVELS, least_confidence: float = LEAST_CONFIDENCE, bootstraps: int = BOOTSTRAPS, least_words: int = LEAST_WORDS) -> DataFrame:
    """context, kind, confidence of the patterns that are trusted, from rows
    (kind or null, contexts, value).

    The graph joins patterns of all levels to the instances they stand at. Seeds score 1 for their
    kind; a pattern's confidence for a kind is the mean score of its instances; another
    instance's score is 1 - prod(1 - confidence) over its patterns with enough seeds. The rounds
    repeat both. Then the instances of trusted patterns are seeds too, wherever they stand, and
    it all starts again until there are no new ones, at most ``bootstraps`` times. One edge per
    pattern and instance is kept, so copies of a text count once.
    """
    places = seen.select("kind", F.explode("contexts").alias("c"), "value").select("kind", "c.*", "value")
    edges = durable(places.groupBy("context", "value").agg(F.max("kind").alias("seed"), F.min("other").alias("other")))
    trusted = durable(_scored(edges, rounds, levels, least_confidence, least_words))
    for _ in range(bootstraps):
        ours = edges.where(F.col("seed").isNull()).join(trusted, "context").where((F.col("kind") == "email") | F.col("value").rlike("[0-9]"))
        new = durable(ours.groupBy("value").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("new")))
        if new.isEmpty():
            break
        edges = durable(edges.join(new, "value", "left").select("context", "value", F.coalesce("seed", "new").alias("seed"), "other"))
        more = _scored(edges, rounds, levels, least_confidence, least_words)
        trusted = durable(trusted.unionByName(more).groupBy("context", "kind").agg(F.max("confidence").alias("confidence")))
    return trusted


def all_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: str | None = None, chars: int = CONTEXT_CHARS, **pattern_options) -> DataFrame:
    """_row, doc_id, base and spans: arrays of (start, place, kind, end), sorted by start and kind's place.

    ``pattern_options`` go to ``trusted_patterns``. An identifier at a trusted pattern of any
    level is of the kind of its most confident one.
    """
    number = F.col(row) if row else F.monotonically_increasing_id()
    rows = docs.select(number.alias("_row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = durable(rows.mapInArrow(_extractor(chars), f"_row {rows.schema['_row'].dataType.simpleString()}, doc_id long, seen {_SEEN_SQL}"))
    seen = found.select("_row", F.explode("seen").alias("s")).select("_row", "s.*")
    trusted = trusted_patterns(seen, **pattern_options)
    place = lambda kind: F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")
    unseen = seen.where(F.col("kind").isNull()).select("_row", "start", "end", "value", F.explode("contexts.context").alias("context")).join(trusted, "context")
    unseen = unseen.where((F.col("kind") == "email") | F.col("value").rlike("[0-9]"))
    judged = unseen.groupBy("_row", "start", "end").agg(F.max_by("kind", F.struct("confidence", "kind")).alias("kind"))
    more = judged.groupBy("_row").agg(F.collect_list(F.struct("start", place(F.col("kind")).alias("place"), "kind", "end")).alias("more"))
    known = F.filter("seen", lambda s: s["kind"].isNotNull())
    base = F.array_sort(F.transform(known, lambda s: F.struct(s["start"].alias("start"), place(s["kind"]).alias("place"), s["kind"].alias("kind"), s["end"].alias("end"))))
    both = sized_join(found.select("_row", "doc_id", base.alias("base")), durable(more), "_row", "left", F.size("more"))
    return both.select("_row", "doc_id", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more"))).alias("spans"))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **pattern_options) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    Null texts are empty and have no spans (an empty string, hashed as such). Repeated rows
    have the same spans; an empty table gives an empty result. Candidate occurrences are found
    in one pass with the base spans, so no text is shuffled.
    """
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    counts = [count(k).alias(f"n_{k}") for k in KINDS]
    return all_spans(docs, id_col, text_col, **pattern_options).select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def masked(text: str, spans) -> str:
    """The text with each span replaced by its kind; of overlapping spans the first names the whole."""
    parts, at = [], 0
    for s in spans:
        if s["start"] >= at:
            parts += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    return "".join([*parts, text[at:]])


def _redactor(text_col, length_col, found):
    def run(batches):
        for batch in text_slices(batches, text_col):
            columns = {k: batch.column(k) for k in batch.schema.names if k != found}
            spans = batch.column(found).to_pylist()
            texts = [masked(t, s) if s else t for t, s in zip(columns[text_col].to_pylist(), spans, strict=True)]
            columns[text_col] = pa.array(texts, columns[text_col].type)
            if length_col in columns:
                lengths = [len(t) if s else n for t, s, n in zip(texts, spans, columns[length_col].to_pylist(), strict=True)]
                columns[length_col] = pa.array(lengths, columns[length_col].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """All input rows with the input's columns; spans are replaced by their kind, as ``[EMAIL]``.

    A column ``length_col``, if there is one, then holds the code points of the new text where
    the text changed. Null and empty texts stay; repeated rows are changed alike; an empty table
    gives an empty result.
    """
    row, found = spare_name(docs, "_row"), spare_name(docs, "_spans")
    named = numbered(docs, row)
    with scratch(docs.sparkSession):
        spans = durable(all_spans(named, id_col, text_col, row).where(F.size("spans") > 0).select(F.col("_row").alias(row), F.col("spans").alias(found)), outlive=True)
    return sized_join(named, spans, row, "left", F.size(found)).drop(row).mapInArrow(_redactor(text_col, length_col, found), docs.schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))
