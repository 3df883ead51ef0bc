"""Personal data: fixed patterns, and terms that give protected entities away.

Entities (addresses and numbers found by pattern) are protected. The corpus says how much a
term beside an entity tells about it: with p(t), p(e) and p(t, e) the shares of documents
that hold the term, the entity, and the term beside the entity, the pointwise mutual
information log p(t, e) / (p(t) p(e)) is compared with the entity's own information
-log p(e). Where the term yields more than the permitted share of it, its occurrences in
documents that hold the entity are generalised too. Evidence has to come from several
different contexts, so copies of one passage prove nothing.

Everything here is DataFrame and SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.llm.tables import checkpointed

#: Share of an entity's information that a term may disclose, and contexts that must agree.
DISCLOSURE, CONTEXTS = 0.9, 3
#: Code points on either side of an entity that count as beside it.
REACH = 80
KINDS = ("email", "ip", "card", "phone")
TERM = "term"

#: Possessive quantifiers and look-behinds change no match: they stop the engine from trying
#: the same run of characters from each of its positions, and from recursing over long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_WORD = r"[\p{L}\p{N}]++"
_SPAN = "array<struct<start:int,end:int,kind:string,ord:int>>"


#: Matches whose places are added up together: with so many in a block, a text of n matches takes about n * BLOCK / 2 steps.
BLOCK = 256


def _located(text: Column, pattern: str, keep, kind: str, order: int) -> Column:
    """Spans of the matches that keep() accepts, by code points."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.transform(F.filter(F.arrays_zip(gaps.alias("g"), found.alias("m")), lambda p: p["m"].isNotNull()), lambda p: F.struct(F.length(p["g"]).alias("gap"), p["m"].alias("m")))
    zero = F.lit(0)
    width = lambda ps: F.aggregate(ps, zero, lambda a, p: a + p["gap"] + F.length(p["m"]))
    span = lambda start, m: F.struct(start.alias("start"), (start + F.length(m)).alias("end"), F.lit(kind).alias("kind"), F.lit(order).alias("ord"))

    def placed(block: Column) -> Column:
        """A block's spans, from its first code point (at) and its matches (ps)."""
        none = F.struct(block["at"].alias("at"), F.array().cast(_SPAN).alias("out"))

        def step(acc: Column, p: Column) -> Column:
            start = acc["at"] + p["gap"]
            return F.struct((start + F.length(p["m"])).alias("at"), F.when(keep(p["m"]), F.concat(acc["out"], F.array(span(start, p["m"])))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(block["ps"], none, step, lambda acc: acc["out"])

    blocks = F.transform(F.sequence(zero, F.floor((F.size(pairs) - 1) / BLOCK).cast("int")), lambda i: F.slice(pairs, i * BLOCK + 1, F.lit(BLOCK)))
    begun = F.struct(zero.alias("at"), F.array().cast("array<struct<at:int,ps:array<struct<gap:int,m:string>>>>").alias("all"))
    grown = lambda acc, ps: F.struct((acc["at"] + width(ps)).alias("at"), F.concat(acc["all"], F.array(F.struct(acc["at"].alias("at"), ps.alias("ps")))).alias("all"))
    many = F.flatten(F.transform(F.aggregate(blocks, begun, grown, lambda acc: acc["all"]), placed))
    few = placed(F.struct(zero.alias("at"), pairs.alias("ps")))
    return F.when(F.size(pairs) == 0, F.array().cast(_SPAN)).when(F.size(pairs) <= BLOCK, few).otherwise(many)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _ip(m: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(F.substring(part(p), 1, 3).try_cast("int"), F.lit(0)) <= 255))


def _card(m: Column) -> Column:
    d = F.reverse(_digits(m))
    doubled = lambda v, i: F.when(i % 2 == 0, v).otherwise(F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2))
    total = F.aggregate(F.transform(F.split(d, "(?<=[0-9])(?=[0-9])"), lambda x, i: doubled(x.cast("int"), i)), F.lit(0), lambda a, b: a + b)
    return F.when(F.length(d).between(12, 19), total % 10 == 0).otherwise(F.lit(False))


def _phone(m: Column) -> Column:
    return F.length(_digits(m)).between(9, 15)


_KEEP = {"email": lambda m: F.lit(True), "ip": _ip, "card": _card, "phone": _phone}
_HINT = {"email": "@", "ip": ".", "phone": "+"}


def base_spans(text: str = "text") -> Column:
    """Pattern spans of a text (null: none) as array<struct<start, end, kind, ord>>, by start, then kind."""
    none = F.array().cast(_SPAN)
    value = F.coalesce(F.col(text), F.lit(""))
    parts = []
    for i, kind in enumerate(KINDS):
        hint = F.contains(value, F.lit(_HINT[kind])) if kind in _HINT else F.lit(True)
        if kind != "email":
            hint &= F.rlike(value, F.lit("[0-9]"))
        parts.append(F.when(hint, _located(value, PATTERNS[kind], _KEEP[kind], kind, i)).otherwise(none))
    return _sorted(F.concat(*parts))


def _sorted(spans: Column) -> Column:
    s = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["ord"].alias("ord"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.transform(s, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), x["ord"].alias("ord"))).cast(_SPAN)


def _terms(text: Column) -> Column:
    """Different words of a text in lower case, three letters or more, without digits."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]++")
    return F.array_distinct(F.filter(words, lambda w: F.rlike(w, F.lit(r"^\p{L}{3,}$"))))


def _beside(text: Column, span: Column) -> Column:
    """What stands within REACH of a span, without words cut at the edge and without addresses."""
    lo = F.greatest(span["start"] - REACH, F.lit(0))
    left = F.substring(text, lo + 1, span["start"] - lo)
    left = F.when(lo > 0, F.regexp_replace(left, r"^\S*+", "")).otherwise(left)
    right = F.substring(text, span["end"] + 1, F.lit(REACH))
    right = F.when(F.length(right) == REACH, F.regexp_replace(right, r"\S*$", "")).otherwise(right)
    return F.regexp_replace(F.concat(left, F.lit(" "), right), r"\S*@\S*", " ")


def _entity(text: Column, span: Column) -> Column:
    value = F.substring(text, span["start"] + 1, span["end"] - span["start"])
    return F.concat(span["kind"], F.lit(":"), F.when(span["kind"] == "email", F.lower(value)).when(span["kind"] == "ip", value).otherwise(_digits(value)))


def disclosing(holders: DataFrame, docs: DataFrame, disclosure: float = DISCLOSURE, contexts: int = CONTEXTS) -> DataFrame:
    """entity, term for every term that tells too much.

    holders: text, __base of the documents that hold an entity; docs: all documents. A
    document counts once for each term, however often it has it; rows that repeat a text count
    as so many documents.
    """
    seen = holders.select("text", F.explode("__base").alias("s"))
    seen = seen.select(_entity(F.col("text"), F.col("s")).alias("entity"), F.md5("text").alias("doc"), _beside(F.col("text"), F.col("s")).alias("beside"))
    known = seen.groupBy("entity", F.md5("beside").alias("context")).agg(F.first("beside").alias("beside"), F.count("*").alias("n"))
    pairs = known.select("entity", "n", F.explode(_terms(F.col("beside"))).alias("term")).groupBy("entity", "term").agg(F.count("*").alias("contexts"), F.sum("n").alias("joint")).where(F.col("contexts") >= contexts)
    holding = seen.groupBy("entity", "doc").agg(F.count("*").alias("n")).groupBy("entity").agg(F.sum("n").alias("with_entity"))
    with_term = docs.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    total = F.lit(float(max(docs.count(), 1)))
    told = pairs.join(with_term, "term").join(holding, "entity")
    share = lambda c: F.least(F.col(c), total) / total
    joint = F.least(F.col("joint"), F.col("with_term"), F.col("with_entity")) / total
    mutual = F.log(joint / (share("with_term") * share("with_entity")))
    return told.where(mutual >= disclosure * -F.log(share("with_entity"))).where(F.col("with_entity") < total).select("entity", "term")


def find(docs: DataFrame, disclosure: float = DISCLOSURE, contexts: int = CONTEXTS) -> DataFrame:
    """docs with __base and __spans: pattern spans, and these with disclosing terms, both by start, then kind.

    Null and empty texts have no spans. Rows with equal texts get equal spans; a null doc_id
    and extra columns are kept as they are (names beginning with two underscores are ours).
    """
    # explode() of a list of one keeps the patterns from being run by the filter and again for its result
    spotted = docs.select("*", F.explode(F.array(base_spans())).alias("__base"))
    holds = F.col("text").isNotNull() & (F.size("__base") > 0)
    holders = checkpointed(spotted.where(holds))
    told = disclosing(holders, docs, disclosure, contexts)
    entities = holders.select(F.md5("text").alias("__key"), F.explode(F.transform("__base", lambda s: _entity(F.col("text"), s))).alias("entity")).distinct()
    terms = entities.join(told, "entity").groupBy("__key").agg(F.collect_set("term").alias("__terms"))
    with_terms = holders.withColumn("__key", F.md5("text")).join(terms, "__key", "left")
    inside = lambda w: F.array_contains("__terms", F.lower(w))
    more = F.filter(_located(F.col("text"), _WORD, inside, TERM, len(KINDS)), lambda t: ~F.exists("__base", lambda b: (t["start"] < b["end"]) & (b["start"] < t["end"])))
    spans = F.when(F.col("__terms").isNotNull(), _sorted(F.concat("__base", more))).otherwise(F.col("__base"))
    rest = spotted.where(~holds).withColumn("__spans", F.col("__base"))
    return with_terms.withColumn("__spans", spans).drop("__key", "__terms").select(rest.columns).unionByName(rest)


def _joined(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame) -> DataFrame:
    """doc_id, counts, base_sha256 and spans of what find() returned."""
    count = lambda k: F.size(F.filter("__base", lambda s: s["kind"] == k)).cast("bigint").alias(f"n_{k}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(_joined("__base"), 256).alias("base_sha256"), _joined("__spans").alias("spans"))


def sanitized(found: DataFrame) -> DataFrame:
    """What find() returned, with each span in text replaced by its kind in brackets, n_chars with it, and without our columns.

    Spans that overlap become one replacement, named after the first.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        new = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], new)).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("__spans", empty, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    changed = found.withColumn("text", F.when(F.size("__spans") > 0, clean).otherwise(F.col("text"))).drop("__base", "__spans")
    return changed.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in changed.columns else changed
