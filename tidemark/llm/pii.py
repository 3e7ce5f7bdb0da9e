"""Personal data by candidate generation and gradient boosting.

Two sets of patterns run over every whole text. The base patterns are strict about format
and checks; their matches are always kept. The generators look for anything that could be
an address, IP, card or phone number written in another way, and their proposals may
overlap. Boosted trees score a proposal by its format (length, digits, separators,
checksum) and its context (the characters around it, cue words before it). They are fitted
on proposals and base matches of a bounded sample of texts, drawn for each kind from those
that hold any: base matches, as they are and rewritten in other formats, are the positive
cases, proposals that fail the checks the negative ones. Over the labelled proposals of all
texts each kind gets the lowest threshold at which nearly all of what passes is right; a
kind for which there is none adds nothing. A proposal that passes is kept where it touches
no base match.

Places are code points. Offsets come from marking matches with a control character that
is first replaced, one for one, where a text holds it itself. Everything is DataFrame and
SQL functions and Spark's own library of models.

NULL text is empty. Equal rows get equal results; extra columns are left out unless they
are named. A table without both positive and negative cases gives the base matches alone.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import compact, text_or_empty
from tidemark.operators.staging import staged

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "A-Za-z0-9._%+-"
# The first matches of the strict patterns, written so that no long run is scanned twice: a
# match begins at the start of its run or where the match before it ended.
_BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_GENERATORS = {
    "email": rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?(?:@|\(at\)|\[at\])\x20?[A-Za-z0-9-]++\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z]{{2,10}}",
    "ip": r"(?<![0-9.])[0-9]{1,4}(?:\x20?(?:\.|\[\.\])\x20?[0-9]{1,4}){3}(?![0-9.])",
    "card": r"(?<![0-9])[0-9](?:[\x20./-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])(?:\+|00)?[(]?[0-9]{1,4}[)]?(?:[\x20./()-]{1,2}[0-9]{2,5}){2,4}(?![0-9])",
}
# Whole words; what may be the end of a word that the context cuts is left out before.
_CUE = r"(?<!\p{L})(?:e-?mail|mail|mailto|phone|telephone|tel|call|mobile|fax|card|visa|credit|addr|address|host|hostname|ip|contact)s?(?!\p{L})"
_MARK, _INSTEAD = "\u0001", "\u0002"
_CONTEXT = 24
_SHORTEST = 4  # characters that any match has at least
SAMPLE = 6000  # texts that the trees are fitted on, about, of each label
FEW = 50  # texts of a kind and label up to which the trees are fitted on all of them
PRECISION = 0.99

FEATURES = (
    "kind_at", "length", "digits", "letters", "spaces", "dashes", "dots", "parens", "plus", "at_sign", "checksum", "octets",
    "before", "after", "cue", "secret",
)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(text: Column) -> Column:
    return F.coalesce(F.call_function("luhn_check", _digits(text)), F.lit(False))


def _octets(text: Column) -> Column:
    parts = F.split(F.regexp_replace(text, r"[^0-9.]", ""), r"\.")
    return (F.size(parts) == 4) & F.forall(parts, lambda p: F.coalesce(p.try_cast("decimal(38,0)") <= 255, F.lit(False)))


def _sound(kind: str, text: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: F.coalesce(F.ltrim(p, F.lit("0")).try_cast("decimal(38,0)") <= 255, F.ltrim(p, F.lit("0")) == ""))
    if kind == "card":
        return _luhn(text)
    if kind == "phone":
        return F.length(_digits(text)).between(10, 15)
    return F.lit(True)


_BASE_SPANS = "array<struct<kind:string,start:int,end:int>>"
_FOUND_SPANS = "array<struct<kind:string,start:int,end:int,found:string,before:string,after:string>>"
_SHIFTS = [1 << k for k in range(31)]


def _with(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, join, *, backward: bool = False) -> Column:
    """What ``join`` makes of each value and all ahead of it (behind it), by spans that double: n log n steps for n values."""
    shifts = F.filter(F.array(*map(F.lit, _SHIFTS)), lambda by: by < F.size(values))

    def further(state: Column, by: Column) -> Column:
        def joined(value: Column, at: Column) -> Column:
            other = F.get(state, at + by if backward else at - by)
            return F.when(other.isNull(), value).otherwise(join(value, other))

        return F.transform(state, joined)

    return F.aggregate(shifts, values, further)


def _matches(text: Column, kind: str, pattern: str, sound=None) -> Column:
    """Matches of a pattern with their places and what stands around them, left to right.

    Pieces at odd places are matches. The last characters ahead of one lie in so many pieces at most.
    """
    pieces = F.split(F.regexp_replace(text, f"({pattern})", f"{_MARK}$1{_MARK}"), _MARK)
    reach = 2 * -(-_CONTEXT // _SHORTEST)

    def spans(pieces: Column, ends: Column, tails: Column) -> Column:
        def span(at: Column) -> Column:
            before = F.substring(F.concat_ws("", *[F.get(tails, at - back) for back in range(reach, 0, -1)]), -_CONTEXT, _CONTEXT)
            after = F.substring(F.concat_ws("", *[F.substring(F.get(pieces, at + ahead), 1, 1) for ahead in (1, 2)]), 1, 1)
            return F.struct(
                F.lit(kind).alias("kind"), F.get(ends, at - 1).alias("start"), F.get(ends, at).alias("end"), F.get(pieces, at).alias("found"),
                before.alias("before"), after.alias("after"),
            )

        places = F.sequence(F.lit(1), F.greatest(F.size(pieces) - 1, F.lit(1)), F.lit(2))
        wanted = places if sound is None else F.filter(places, lambda at: sound(F.get(pieces, at)))
        return F.transform(wanted, span)

    def placed(pieces: Column) -> Column:
        ends = _running(F.transform(pieces, F.length), lambda length, ahead: length + ahead)
        tails = F.transform(pieces, lambda piece: F.substring(piece, -_CONTEXT, _CONTEXT))
        return _with(ends, lambda ends: _with(tails, lambda tails: spans(pieces, ends, tails)))

    return F.when(text.rlike(pattern), _with(pieces, placed)).otherwise(F.array().cast(_FOUND_SPANS)).cast(_FOUND_SPANS)


def _scannable(text: Column) -> Column:
    return F.when(F.contains(text, F.lit(_MARK)), F.translate(text, _MARK, _INSTEAD)).otherwise(text)


def _kind_place(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int")


def _compared(base: Column, wide: Column) -> Column:
    """All spans, equal ones once: whether each is a strict match, touches one, or is a part of (or overlaps) one of its own kind.

    Sorted by start, a span touches an earlier match if the furthest end of these lies behind
    its start, and a later one if the nearest start of these lies ahead of its end. Ends and
    starts are kept per kind.
    """

    def marked(spans: Column, wide: bool) -> Column:
        return F.transform(
            spans,
            lambda s: F.struct(
                s["start"].alias("start"), _kind_place(s["kind"]).alias("at"), s["end"].alias("end"), F.lit(wide).alias("wide"),
                s["kind"].alias("kind"), s["found"].alias("found"), s["before"].alias("before"), s["after"].alias("after"),
            ),
        )

    def per_kind(spans: Column, bound: str) -> Column:
        return F.transform(spans, lambda s: F.array(*[F.when(~s["wide"] & (s["at"] == k), s[bound]) for k in range(1, len(KINDS) + 1)]))

    def told(spans: Column, ends: Column, starts: Column) -> Column:
        def first(s: Column, at: Column) -> Column:
            previous = F.get(spans, at - 1)
            same = (previous["start"] == s["start"]) & (previous["end"] == s["end"]) & (previous["at"] == s["at"])
            return ~F.coalesce(same, F.lit(False))

        def flags(s: Column, at: Column) -> Column:
            ahead, behind = F.get(ends, at - 1), F.get(starts, at + 1)
            touches = F.coalesce(F.array_max(ahead) > s["start"], F.lit(False)) | F.coalesce(F.array_min(behind) < s["end"], F.lit(False))
            own = F.coalesce(F.get(ahead, s["at"] - 1) > s["start"], F.lit(False)) | F.coalesce(F.get(behind, s["at"] - 1) < s["end"], F.lit(False))
            return F.struct(
                s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["found"].alias("found"), s["before"].alias("before"), s["after"].alias("after"),
                (~s["wide"]).alias("strict"), (~s["wide"] | touches).alias("touches"), (s["wide"] & own).alias("part"), first(s, at).alias("first"),
            )

        return F.filter(F.transform(spans, flags), lambda s: s["first"])

    def compared(spans: Column) -> Column:
        ends = _running(per_kind(spans, "end"), lambda x, y: F.zip_with(x, y, lambda a, b: F.greatest(a, b)))
        starts = _running(per_kind(spans, "start"), lambda x, y: F.zip_with(x, y, lambda a, b: F.least(a, b)), backward=True)
        return _with(ends, lambda ends: _with(starts, lambda starts: told(spans, ends, starts)))

    return _with(F.array_sort(F.concat(marked(base, False), marked(wide, True))), compared)


def scan(docs: DataFrame, carry: Sequence[str] = ()) -> DataFrame:
    """``doc_id, content, base, proposed`` of every row: strict matches, and proposals with their surroundings.

    The work grows with the length of a text and with its matches times their logarithm.
    """
    text = text_or_empty()
    rows = docs.select("doc_id", *carry, F.xxhash64(text).alias("content"), _scannable(text).alias("_text"))
    base = F.concat(*[_matches(F.col("_text"), kind, _BASE[kind], lambda piece, kind=kind: _sound(kind, piece)) for kind in KINDS])
    wide = F.concat(*[_matches(F.col("_text"), kind, _GENERATORS[kind]) for kind in KINDS])
    found = rows.select("doc_id", *carry, "content", base.alias("_base"), wide.alias("_wide"))
    plain = F.transform("_base", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).cast(_BASE_SPANS)
    return found.select("doc_id", *carry, "content", plain.alias("base"), _compared(F.col("_base"), F.col("_wide")).alias("proposed"))


def _features(rows: DataFrame) -> DataFrame:
    """Numbers that describe a proposal's format and context; ``rows`` hold kind, found, before and after."""
    found, before = F.col("found"), F.lower("before")
    whole = F.when(F.length("before") < _CONTEXT, before).otherwise(F.regexp_replace(before, r"^\p{L}+", ""))

    def count(pattern: str) -> Column:
        return F.length(F.regexp_replace(found, f"[^{pattern}]", "")).cast("double")

    def kind_of_character(text: Column) -> Column:
        return F.when(text == "", 0.0).when(text.rlike(r"^\s$"), 1.0).when(text.rlike("^[0-9]$"), 2.0).when(text.rlike(r"^\p{L}$"), 3.0).otherwise(4.0)

    numbers = {
        "kind_at": _kind_place(F.col("kind")).cast("double"),
        "length": F.length(found).cast("double"),
        "digits": count("0-9"),
        "letters": count("A-Za-z"),
        "spaces": count(r"\x20"),
        "dashes": count("-"),
        "dots": count("."),
        "parens": count("()"),
        "plus": count("+"),
        "at_sign": count("@"),
        "checksum": _luhn(found).cast("double"),
        "octets": _octets(found).cast("double"),
        "before": kind_of_character(F.when(F.length("before") > 0, F.substring("before", -1, 1)).otherwise("")),
        "after": kind_of_character(F.col("after")),
        "cue": whole.rlike(_CUE).cast("double"),
        "secret": before.rlike("token|key|password|secret|hash|sha|id\\b").cast("double"),
    }
    return rows.withColumns(numbers)


def _impossible(kind: Column, found: Column) -> Column:
    """Whether a proposal cannot be right in any way of writing it: an octet over 255, a failed checksum, too few or many digits."""
    digits = F.length(_digits(found))
    return (
        F.when(kind == "ip", ~_octets(found))
        .when(kind == "card", ~_luhn(found) | ~digits.between(14, 19))
        .when(kind == "phone", ~digits.between(10, 15))
        .otherwise(F.lit(False))
    )


def _rewritten(positive: DataFrame) -> DataFrame:
    """Strict matches in other ways of writing them, in the same places."""
    digits = _digits(F.col("found"))
    groups = F.array_join(F.array(*[F.substring(digits, 1 + 4 * k, 4) for k in range(5)]), ".")
    other = (
        F.when(F.col("kind") == "email", F.regexp_replace(F.regexp_replace("found", "@", " (at) "), r"\.([A-Za-z]+)$", " (dot) $1"))
        .when(F.col("kind") == "ip", F.regexp_replace("found", r"\.", "[.]"))
        .when(F.col("kind") == "card", F.regexp_replace(groups, r"\.+$", ""))
        .otherwise(F.concat(F.lit("("), F.substring(digits, -10, 3), F.lit(") "), F.substring(digits, -7, 3), F.lit("-"), F.substring(digits, -4, 4)))
    )
    return positive.withColumn("found", other)


def _examples(proposals: DataFrame) -> DataFrame:
    """Labelled proposals of all texts, with their features.

    A part of a strict match is neither right nor wrong, and what is no strict match after a cue word may be right unless it fails a check.
    """
    labelled = proposals.filter("NOT part").withColumn("label", F.col("strict").cast("double"))
    more = _rewritten(labelled.filter("strict")).select(*labelled.columns)
    return _features(labelled.unionByName(more)).filter((F.col("label") == 1) | (F.col("cue") == 0) | _impossible(F.col("kind"), F.col("found")))


def _proposals(scanned: DataFrame) -> DataFrame:
    """One row per proposal: whether it is a strict match, touches any, or is a part of one of its kind."""
    return scanned.select("doc_id", "content", F.explode("proposed").alias("span")).select("doc_id", "content", "span.*").drop("first")


def _certain(scored: DataFrame) -> Column:
    return vector_to_array(scored["probability"])[1]


def learn(proposals: DataFrame, *, sample: int = SAMPLE) -> tuple[GBTClassificationModel, dict[str, float]] | None:
    """Trees, from about ``sample`` texts of each label, and the threshold of each kind, from all; None without both labels.

    Each kind takes an equal part of the sample. More than four fifths of a kind's texts are only taken if these are few.
    """
    examples = _examples(proposals)
    groups = examples.groupBy("kind", "label").agg(F.approx_count_distinct("content").alias("texts")).collect()  # eight numbers
    if len({r["label"] for r in groups}) < 2:
        return None
    shares = {r: 1.0 if r["texts"] <= FEW else min(0.8, sample / len(KINDS) / r["texts"]) for r in groups}
    share = F.coalesce(*[F.when((F.col("kind") == r["kind"]) & (F.col("label") == r["label"]), F.lit(part)) for r, part in shares.items()])
    drawn = F.shiftrightunsigned(F.xxhash64("content", F.lit("sample")), 11) / F.lit(float(1 << 53))
    told = [c for c in examples.columns if c != "doc_id"]
    fitted = staged(examples.filter(drawn < share).select(told).distinct())
    if fitted.select("label").distinct().count() < 2:
        return None
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    model = GBTClassifier(maxIter=12, maxDepth=3, stepSize=0.3, seed=7, checkpointInterval=-1).fit(gather.transform(fitted).coalesce(4))
    scored = model.transform(gather.transform(examples))
    scored = scored.select("kind", "label", F.round(_certain(scored), 6).alias("certain"))
    levels = scored.groupBy("kind", "certain").agg(F.sum("label").alias("right"), F.count(F.lit(1)).alias("all"))
    down = Window.partitionBy("kind").orderBy(F.desc("certain"))
    levels = levels.withColumns({"right": F.sum("right").over(down), "all": F.sum("all").over(down)})
    good = levels.filter(F.col("right") >= PRECISION * F.col("all")).groupBy("kind").agg(F.min("certain").alias("least"))
    return model, {r["kind"]: max(r["least"], 0.5) for r in good.collect()}  # one number per kind


def added_spans(scanned: DataFrame, learned) -> DataFrame:
    """``doc_id, content, added``: proposals that pass their threshold and touch no strict match."""
    proposals = _proposals(scanned).filter("NOT touches")
    if learned is None:
        return proposals.filter(F.lit(False)).groupBy("doc_id", "content").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))
    model, thresholds = learned
    features = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(_features(proposals))
    scored = model.transform(features)
    least = F.coalesce(*[F.when(F.col("kind") == k, F.lit(t)) for k, t in thresholds.items()], F.lit(2.0))
    passed = scored.filter(F.round(_certain(scored), 6) >= least)
    return passed.groupBy("doc_id", "content").agg(F.collect_set(F.struct("kind", "start", "end")).alias("added"))


def _ordered(spans: Column) -> Column:
    """By start, then by kind as listed, then by end."""
    placed = F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), _kind_place(s["kind"]).alias("at"), s["end"].alias("end"), s["kind"].alias("kind")),
    )
    return F.array_sort(placed)


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(_ordered(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame, carry: Sequence[str] = (), *, sample: int = SAMPLE) -> DataFrame:
    """``doc_id``, carried columns, ``base`` and ``spans`` (all kept spans, in order) of every row of ``docs``."""
    scanned = compact(scan(docs, carry))
    learned = learn(_proposals(scanned), sample=sample)
    added = added_spans(scanned, learned).withColumnsRenamed({"doc_id": "_id", "content": "_content"})
    together = scanned.join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("content") == F.col("_content")), "left")
    spans = F.concat("base", F.coalesce("added", F.array().cast(_BASE_SPANS)))
    return together.select("doc_id", *carry, "content", "base", spans.alias("spans"))


def summary(found: DataFrame) -> DataFrame:
    """Counts and digests of strict matches and the list of all spans, per row."""
    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")

    counts = {f"n_{k}": number(k) for k in KINDS}
    return found.select("doc_id", *[c.alias(n) for n, c in counts.items()], F.sha2(_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), _text(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """``text`` with each span, overlapping ones as one, replaced by its kind in angle brackets.

    The text is cut into blocks first, so that no part of it is looked for from the start.
    """

    def part(blocks: Column, start: Column, end: Column) -> Column:
        def of_block(at: Column) -> Column:
            ahead = at * _BLOCK
            begin = F.greatest(start - ahead, F.lit(0))
            return F.substring(F.get(blocks, at), begin + 1, F.least(end - ahead, F.lit(_BLOCK)) - begin)

        touched = F.sequence((start / _BLOCK).cast("int"), ((end - 1) / _BLOCK).cast("int"))
        return F.when(start < end, F.array_join(F.transform(touched, of_block), "")).otherwise("")

    def replaced(blocks: Column, spans: Column, ends: Column) -> Column:
        def piece(s: Column, at: Column) -> Column:
            done = F.coalesce(F.get(ends, at - 1), F.lit(0))
            return F.when(s["start"] >= done, F.concat(part(blocks, done, s["start"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise("")

        rest = part(blocks, F.coalesce(F.get(ends, F.size(ends) - 1), F.lit(0)), F.length(text))
        return F.concat(F.array_join(F.transform(spans, piece), ""), rest)

    def of_spans(blocks: Column, spans: Column) -> Column:
        ends = _running(F.transform(spans, lambda s: s["end"]), lambda x, y: F.greatest(x, y))
        return _with(ends, lambda ends: replaced(blocks, spans, ends))

    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}"), F.lit(0))
    return _with(blocks, lambda blocks: _with(_ordered(spans), lambda spans: of_spans(blocks, spans)))


_BLOCK = 512
