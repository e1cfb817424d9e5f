r"""PII: patterns for base kinds and bootstrapped contextual extraction, in DataFrame functions only.

Base spans: emails, IP addresses, payment cards and phone numbers, by regular expressions, leftmost and
not overlapping within a kind; matches that fail their check are dropped. The expressions used here
start only where a match may start and never give back digits, which finds the same matches in
linear time.

Bootstrap: base spans and identifier-like tokens are instances. What stands beside an instance are its
lexical patterns: the word to its left, that word with the signs up to the instance (as `token = "`), the
word to its right, and both words. Seeds are the base spans, with the score 1; tokens of the shape of digests
and keys are likely, with the score 0.5; other tokens start at 0. On the graph of patterns and instances, a
pattern's confidence is the sum of its instances' scores over their number plus a prior; an instance's score is
the noisy-or of its patterns that have enough support, its own start at least. Rounds go on until scores settle
or `rounds` are done; tokens with a high score that overlap no base span are identifiers of kind `id`.

Defined cases: null and empty texts have no spans. Places are code points, ends exclusive. Repeated
rows are found each, but count once as evidence, as evidence is of distinct instances. Other columns
are ignored by find_pii and kept by mask_pii.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, kept

LOCAL = "A-Za-z0-9._%+-"
#: Kind to its expression, in the order in which spans are listed.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a kind to be looked for.
HINTS = {"email": "@", "phone": "+"}
KINDS = [*PATTERNS, "id"]
#: Tokens of 6 to 64 signs with a digit.
TOKEN = r"(?<![A-Za-z0-9])(?=[A-Za-z._@:/+-]*+[0-9])[A-Za-z0-9][A-Za-z0-9._@:/+-]{4,62}(?<=[A-Za-z0-9])(?![A-Za-z0-9])"
#: The shape of digests and keys: 32 hexadecimal signs or more, letters and digits.
DIGEST, LIKELY = r"^(?=[0-9]*+[A-Fa-f])(?=[A-Fa-f]*+[0-9])[0-9A-Fa-f]{32,}$", 0.5

SPAN = "array<struct<kind:int,first:int,last:int>>"
INSTANCE = "array<struct<first:int,last:int,value:string,left:string,lead:string,right:string,start:double>>"
ROUNDS, SETTLED, SUPPORT, PRIOR, CONFIDENT = 6, 0.01, 3.0, 2.0, 0.8
#: Matches whose places are added up in one go.
STEP = 256


def let(value: Column, body) -> Column:
    """`body` of a value that is worked out once; an expression that a lambda names is worked out each time."""
    return F.transform(F.array(value), body)[0]


def located(text: Column, pattern: str) -> Column:
    """Matches as array<struct<first, last, value, before, after>>: text between matches gives the places. They
    are added up in steps of some matches, as each addition to an array copies it."""
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rows = F.arrays_zip(F.slice(parts, 1, F.size(hits)).alias("before"), hits.alias("value"), F.slice(parts, 2, F.size(hits)).alias("after"))
    empty = F.array().cast("array<struct<first:int,last:int,value:string,before:string,after:string>>")

    def step(state: Column, row: Column) -> Column:
        first = state["at"] + F.length(row["before"])
        last = first + F.length(row["value"])
        found = F.struct(
            first.alias("first"),
            last.alias("last"),
            row["value"].alias("value"),
            F.substring(row["before"], -48, 48).alias("before"),
            F.substring(row["after"], 1, 48).alias("after"),
        )
        return F.struct(last.alias("at"), F.concat(state["out"], F.array(found)).alias("out"))

    def one(rows: Column) -> Column:
        return F.aggregate(rows, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda s: s["out"])

    def several(rows: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(rows) - 1) / STEP).cast("int")), lambda k: F.slice(rows, k * STEP + 1, STEP))
        sizes = lambda bs: F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda n, r: n + F.length(r["before"]) + F.length(r["value"])))
        starts = lambda bs: F.aggregate(sizes(bs), F.array(F.lit(0)), lambda at, n: F.concat(at, F.array(F.element_at(at, -1) + n)))
        whole = lambda bs, at: F.transform(bs, lambda b, i: F.aggregate(b, F.struct(F.element_at(at, i + 1).alias("at"), empty.alias("out")), step, lambda s: s["out"]))
        return let(blocks, lambda bs: let(starts(bs), lambda at: F.flatten(whole(bs, at))))

    return let(rows, lambda r: F.when(F.size(r) <= STEP, one(r)).otherwise(several(r)))


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    own = F.transform(F.reverse(F.split(number, "")), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2))
    return F.aggregate(own, F.lit(0), lambda a, d: a + d - F.when(d > 9, 9).otherwise(0)) % 10 == 0


def passes(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.rlike("^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})$"))
    if kind == "card":
        return luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(8, 15)
    return F.lit(True)


def base_hits(text: Column) -> Column:
    """All base matches as array<struct<kind, hit>>, by kind, then by place."""
    has_digit = text.rlike("[0-9]")
    none = F.array().cast("array<struct<kind:int,hit:struct<first:int,last:int,value:string,before:string,after:string>>>")

    def of(k: int, kind: str, pattern: str) -> Column:
        needed = text.contains(HINTS[kind]) if kind in HINTS else has_digit
        good = F.filter(located(text, pattern), lambda h: passes(kind, h["value"]))
        return F.when(needed, F.transform(good, lambda h: F.struct(F.lit(k).alias("kind"), h.alias("hit")))).otherwise(none)

    return F.concat(*(of(k, kind, pattern) for k, (kind, pattern) in enumerate(PATTERNS.items())))


def base_spans(hits: Column) -> Column:
    return F.transform(hits, lambda h: F.struct(h["kind"].alias("kind"), h["hit"]["first"].alias("first"), h["hit"]["last"].alias("last")))


def instance(hit: Column, start: Column) -> Column:
    """A match with what stands beside it and the score that it starts with."""
    words = lambda c, pattern: F.lower(F.regexp_extract(c, pattern, 1))
    return F.struct(
        hit["first"].alias("first"),
        hit["last"].alias("last"),
        hit["value"].alias("value"),
        words(hit["before"], r"(\p{L}+)[^\p{L}]*$").alias("left"),
        words(hit["before"], r"(\p{L}+[^\p{L}]{1,8})$").alias("lead"),
        words(hit["after"], r"^[^\p{L}]*(\p{L}+)").alias("right"),
        start.alias("start"),
    )


def candidates(text: Column) -> Column:
    """Identifier-like tokens as instances."""
    made = F.transform(located(text, TOKEN), lambda h: instance(h, F.when(h["value"].rlike(DIGEST), LIKELY).otherwise(0.0)))
    return F.when(text.rlike("[0-9]"), made).otherwise(F.array().cast(INSTANCE))


def instance_scores(instances: DataFrame, rounds: int = ROUNDS, support: float = SUPPORT, prior: float = PRIOR) -> DataFrame:
    """(value, score) of the instances (value, left, lead, right, start)."""
    named = lambda kind, *parts: F.when(F.length(parts[0]) * F.length(parts[-1]) > 0, F.concat_ws(" ", F.lit(kind), *parts))
    patterns = F.array_compact(F.array(*(named(k, F.col(k)) for k in ("left", "lead", "right")), named("both", F.col("left"), F.col("right"))))
    edges = kept(instances.select("value", "start", F.explode(patterns).alias("pattern")).groupBy("pattern", "value").agg(F.max("start").alias("start")), "edges")
    starts = edges.groupBy("value").agg(F.max("start").alias("start"))
    scores = kept(starts.select("value", "start", F.col("start").alias("score"), F.lit(1.0).alias("change")), "scores")
    links = edges.select("pattern", "value")
    for _ in range(rounds):
        weighed = links.join(scores.select("value", "score"), "value").groupBy("pattern").agg(F.sum("score").alias("good"), F.count(F.lit(1)).alias("n"))
        sure = weighed.filter(F.col("good") >= support).select("pattern", (F.col("good") / (F.col("n") + prior)).alias("confidence"))
        reached = links.join(sure, "pattern").groupBy("value").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("found"))
        better = F.greatest("start", F.coalesce("found", F.lit(0.0)))
        fresh = kept(scores.join(reached, "value", "left").select("value", "start", better.alias("score"), F.abs(better - F.col("score")).alias("change")), "scores")
        dropped(scores)
        scores = fresh
        if (scores.agg(F.max("change")).first()[0] or 0.0) < SETTLED:
            break
    dropped(edges)
    return scores.select("value", "score")


def with_spans(documents: DataFrame, text: str = "text", confident: float = CONFIDENT) -> DataFrame:
    """`documents` with a column `pii`, array<struct<kind, first, last>> sorted by kind and place, and
    `pii_base`, the base ones. Documents are written once with what is found in them."""
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    names = documents.columns
    hits = documents.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"), F.monotonically_increasing_id().alias("id"), base_hits(body).alias("hits"), candidates(body).alias("tokens"))
    base = F.transform("hits", lambda h: instance(h["hit"], F.lit(1.0)))
    free = F.filter("tokens", lambda c: ~F.exists("hits", lambda s: (s["hit"]["first"] < c["last"]) & (s["hit"]["last"] > c["first"])))
    found = kept(hits.select("row", "id", base_spans(F.col("hits")).alias("spans"), base.alias("seeds"), free.alias("candidates")), "pii")
    every = found.select(F.explode(F.concat("seeds", "candidates")).alias("c")).select("c.*")
    values = instance_scores(every).filter(F.col("score") >= confident).select("value")
    loose = found.select("id", F.explode("candidates").alias("c")).select("id", F.col("c.value").alias("value"), F.struct(F.lit(len(PATTERNS)).alias("kind"), F.col("c.first").alias("first"), F.col("c.last").alias("last")).alias("span"))
    more = loose.join(values, "value").groupBy("id").agg(F.array_sort(F.collect_list("span")).alias("more"))
    may = F.size("candidates") > 0
    joined = found.filter(may).join(more, "id", "left").select("row", "spans", F.coalesce("more", F.array().cast(SPAN)).alias("more"))
    rest = found.filter(~may).select("row", "spans", F.array().cast(SPAN).alias("more"))
    return joined.unionByName(rest).select("row.*", F.concat("spans", "more").alias("pii"), F.col("spans").alias("pii_base"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["first"].cast("string"), s["last"].cast("string"))), ",")


def find_pii(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: key, pii (all spans) and pii_base."""
    return with_spans(documents.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))).select("key", "pii", "pii_base")


def masked(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of overlapping spans one mark remains."""
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["first"].alias("first"), s["last"].alias("last"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        fresh = F.concat(state["out"], F.substring(text, state["at"] + 1, s["first"] - state["at"]), F.element_at(names, s["kind"] + 1))
        return F.struct(F.greatest(state["at"], s["last"]).alias("at"), F.when(s["first"] >= state["at"], fresh).otherwise(state["out"]).alias("out"))

    done = F.aggregate(order, start, step)
    return F.when(F.size(spans) > 0, F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text)))).otherwise(text)


def mask_pii(documents: DataFrame, text: str = "text") -> DataFrame:
    """`documents` with all spans in the text masked. A null text stays null."""
    names = documents.columns
    own = documents.select(*(F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)))
    t = f"_{names.index(text)}"
    done = with_spans(own, t).withColumn(t, masked(F.col(t), F.col("pii")))
    return done.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)))
