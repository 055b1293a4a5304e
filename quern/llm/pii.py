"""PII spans, and terms that give protected entities away. DataFrame functions only.

Base spans are e-mail addresses, IP addresses, card and phone numbers, by
pattern and check. Each found value is a protected entity.

The corpus then tells how strongly a term reveals an entity. With N documents,
n(e) that hold the entity, n(t) that hold the term and n(e,t) that hold the term
within ``CONTEXT`` characters of the entity, the term's disclosure is

    PMI(e;t) / IC(e) = ln(n(e,t) N / (n(e) n(t))) / ln(N / n(e))

1 means that the term alone names the entity. Terms at or over ``DISCLOSURE``,
seen with the entity in at least ``SUPPORT`` documents, become spans of kind
``term`` wherever they stand, in every text. Counts cover all texts, without
their base spans.

The patterns start only where a run starts and use possessive groups, which
gives the same leftmost matches in linear time and without deep recursion.

Defined results: null and empty texts have no spans; rows equal in id and text
get equal spans; documents are counted by id, a null id as one document; an
empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import identified, public_id
from quern.session import materialise

KINDS = ["email", "ip", "card", "phone"]
CONTEXT = 60
DISCLOSURE = 0.8
SUPPORT = 2

# The base patterns, as started and grouped for linear matching.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# Found somewhere in every text in which the pattern matches.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]++"


def located(text: Column, pattern: str) -> Column:
    """``array<struct<start, end, value>>`` of the leftmost matches, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)  # one more than found
    none = F.array().cast("array<struct<start:int,end:int,value:string>>")
    steps = F.filter(F.zip_with(found, between, lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap"))), lambda x: x["m"].isNotNull())

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + step["gap"]
        end = start + F.length(step["m"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(F.struct(start.alias("start"), end.alias("end"), step["m"].alias("value")))).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda state: state["out"])


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Checksum of a string of digits."""
    back = F.split(F.reverse(number), "")
    back = F.filter(back, lambda d: d != "")

    def value(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.transform(back, value), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=.)", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    size = F.length(digits(value))
    if kind == "card":
        return size.between(14, 19) & luhn(digits(value))
    if kind == "phone":
        return size.between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """``array<struct<start, turn, end, value>>`` of all kinds, by start and kind."""
    return F.sort_array(F.concat(*[_spans_of(text, turn, kind) for turn, kind in enumerate(KINDS)]))


def _spans_of(text: Column, turn: int, kind: str) -> Column:
    spans = F.filter(located(text, PATTERNS[kind]), lambda s: valid(kind, s["value"]))
    spans = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(turn).alias("turn"), s["end"].alias("end"), s["value"].alias("value")))
    return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array().cast("array<struct<start:int,turn:int,end:int,value:string>>"))


def entity_key(span: Column) -> Column:
    """Name of the entity of a span; card and phone numbers by their digits, however they are written."""
    number = span["turn"].isin(KINDS.index("card"), KINDS.index("phone"))
    return F.concat(span["turn"].cast("string"), F.lit(":"), F.when(number, digits(span["value"])).otherwise(F.lower(span["value"])))


def _outside(text: Column, spans: Column) -> Column:
    """The text with its base spans blanked, at the same length."""
    def blank(state: Column, s: Column) -> Column:
        start = F.greatest(s["start"], state["at"])
        out = F.concat(state["out"], F.substring(text, state["at"] + 1, start - state["at"]), F.repeat(F.lit(" "), s["end"] - start))
        return F.when(s["end"] > state["at"], F.struct(s["end"].alias("at"), out.alias("out"))).otherwise(state)

    rest = lambda state: F.concat(state["out"], F.substring(text, state["at"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), blank, rest)).otherwise(text)


def _words(text: Column) -> Column:
    """Terms of a text, once each."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.lower))


def _places(text: Column, wanted: Column) -> Column:
    """Spans of the wanted terms; one pass over the text."""
    none = F.array().cast("array<struct<start:int,turn:int,end:int,value:string>>")
    steps = F.zip_with(F.regexp_extract_all(text, F.lit(TERM), F.lit(0)), F.split(text, TERM, -1), lambda m, gap: F.struct(m.alias("m"), F.length(gap).alias("gap")))

    def add(state: Column, step: Column) -> Column:
        start = state["at"] + step["gap"]
        end, value = start + F.length(step["m"]), F.lower(step["m"])
        span = F.struct(start.alias("start"), F.lit(len(KINDS)).alias("turn"), end.alias("end"), value.alias("value"))
        return F.struct(end.alias("at"), F.when(F.array_contains(wanted, value), F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    steps = F.filter(steps, lambda x: x["m"].isNotNull())
    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda state: state["out"])


def _terms_near(text: Column, span: Column) -> Column:
    """Whole terms in the context of a span: ``array<struct<entity, term>>``."""
    low = F.greatest(span["start"] - CONTEXT, F.lit(0))
    entity = entity_key(span)
    left, right = F.substring(text, low + 1, span["start"] - low), F.substring(text, span["end"] + 1, F.lit(CONTEXT))
    # a term cut by the edge of the context is not whole
    before = F.filter(located(left, TERM), lambda t: (low == 0) | (t["start"] > 0))
    after = F.filter(located(right, TERM), lambda t: (t["end"] < CONTEXT) | (span["end"] + CONTEXT >= F.length(text)))

    return F.transform(F.concat(before, after), lambda t: F.struct(entity.alias("entity"), F.lower(t["value"]).alias("term")))


def base_rows(rows: DataFrame) -> DataFrame:
    """``(id, mark, spans, outside, near)`` per row of ``rows(id, mark, text)``."""
    text = F.coalesce("text", F.lit(""))
    found = rows.select("id", "mark", text.alias("text"), base_spans(text).alias("spans"))
    found = found.select("id", "mark", "spans", _outside(F.col("text"), F.col("spans")).alias("outside"))
    near = F.flatten(F.transform("spans", lambda s: _terms_near(F.col("outside"), s)))
    near = F.when(F.size("spans") > 0, near).otherwise(F.array().cast("array<struct<entity:string,term:string>>"))
    return found.select("id", "mark", "spans", "outside", near.alias("near"))


def _documents_per_term(base: DataFrame) -> DataFrame:
    """``(term, n_t)``: distinct ids whose texts hold the term. Only ids with several rows travel with their terms."""
    many = materialise(base.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select("id", F.col("id").alias("shared")))
    words = base.join(many, "id", "left").select("shared", F.explode(_words(F.col("outside"))).alias("term"))
    counts = words.groupBy("term", "shared").agg(F.count("*").alias("n"))
    return counts.groupBy("term").agg(F.sum(F.when(F.col("shared").isNull(), F.col("n")).otherwise(1)).alias("n_t"))


def disclosing_terms(rows: DataFrame, base: DataFrame) -> DataFrame:
    """``(entity, term, disclosure)`` of pairs at or over the threshold."""
    texts = rows.where(F.col("text").isNotNull())
    total = F.lit(float(texts.select("id").distinct().count()))
    entity = F.transform("spans", entity_key)
    entities = base.select("id", F.explode(entity).alias("entity")).distinct().groupBy("entity").agg(F.count("*").alias("n_e"))
    uses = base.select("id", F.explode("near").alias("u")).select("id", "u.entity", "u.term").distinct()
    together = uses.groupBy("entity", "term").agg(F.count("*").alias("n_et")).where(F.col("n_et") >= SUPPORT)
    terms = _documents_per_term(base)
    wanted = together.join(entities, "entity").join(terms, "term")
    joint = F.col("n_et") * total / (F.col("n_e") * F.greatest("n_t", "n_et"))
    rare = total / F.col("n_e")
    disclosure = F.when(rare > 1, F.log(joint) / F.log(rare))
    return wanted.select("entity", "term", disclosure.alias("disclosure")).where(F.col("disclosure") >= DISCLOSURE)


def find_spans(docs: DataFrame) -> DataFrame:
    """``(id, mark, spans, terms)`` per row; ``terms`` are the spans that the method adds."""
    rows = identified(docs)
    base = materialise(base_rows(rows))
    shown = materialise(disclosing_terms(rows, base).select("term").distinct())
    held = base.select("id", "mark", F.explode(_words(F.col("outside"))).alias("term")).join(shown, "term")
    # written first, so that their size decides how they are joined with the texts
    held = materialise(held.groupBy("id", "mark").agg(F.collect_set("term").alias("held")))
    none = F.array().cast("array<struct<start:int,turn:int,end:int,value:string>>")
    terms = F.when(F.col("held").isNotNull(), _places(F.col("outside"), F.col("held"))).otherwise(none)
    return base.join(held, ["id", "mark"], "left").select("id", "mark", "spans", terms.alias("terms"))


def _written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, "term")])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["turn"]), s["start"], s["end"])), ",")


def pii_report(docs: DataFrame) -> DataFrame:
    """Counts per kind, digest of the base spans and all spans, for every row."""
    done = find_spans(docs)
    def count(turn: int, kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["turn"] == turn)).cast("long").alias(f"n_{kind}")

    counts = [count(turn, kind) for turn, kind in enumerate(KINDS)]
    every = F.sort_array(F.concat("spans", "terms"))
    return done.select(public_id().alias("doc_id"), *counts, F.sha2(_written(F.col("spans")), 256).alias("base_sha256"),
                       _written(every).alias("spans"), F.size("terms").cast("long").alias("n_term"))


def sanitised(docs: DataFrame) -> DataFrame:
    """``(id, mark, text)`` with entities generalised to their kind and disclosing terms removed."""
    spans = find_spans(docs).select("id", "mark", "spans", "terms").distinct()
    joined = identified(docs).join(spans, ["id", "mark"])
    every = F.sort_array(F.concat("spans", "terms"))
    # of overlapping spans the first stays
    clear = F.aggregate(every, F.filter(every, lambda s: F.lit(False)), lambda out, s: F.when(
        (F.size(out) > 0) & (F.get(out, F.size(out) - 1)["end"] > s["start"]), out).otherwise(F.concat(out, F.array(s))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit(""))
    text = F.coalesce("text", F.lit(""))
    end = lambda i: F.coalesce(F.get(F.col("clear"), i)["end"], F.lit(0))
    parts = F.transform("clear", lambda s, i: F.concat(F.substring(text, end(i - 1) + 1, s["start"] - end(i - 1)), F.get(names, s["turn"])))
    whole = F.concat(F.array_join(parts, ""), F.substring(text, end(F.size("clear") - 1) + 1, F.length(text)))
    return joined.withColumn("clear", clear).select("id", "mark", whole.alias("text"))
