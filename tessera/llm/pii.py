"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Seeds are four kinds of entities found by patterns: e-mail addresses, IP addresses, card numbers and
phone numbers. Every mention of a seed or of another token whose form may be of a kind induces lexical patterns: the word before it,
the two words before it, the word after it, and the words on both sides; words are lower-cased, without outer punctuation, their
digits made equal. Patterns and instances (normalised tokens) of a kind form a bipartite graph of distinct edges.
A pattern's confidence in a kind is the lower end of the Wilson interval (``Z`` standard errors) of its precision, the
mean score of its instances: 1 for seeds, that of the most confident pattern that vouches for it for others, else 0. Patterns with at
least ``min_seeds`` instances that score and ``min_confidence`` vouch; what they vouch for counts as found in the next round and may induce further
patterns, until no pattern is added. Found are the tokens that suit the kind, wherever they stand in such a pattern. So are digit groups written
with spaces (for card and phone, the most whole groups that suit) and tokens like ``a[at]b[dot]c``;
these have no part in the confidences.

Positions come from ``regexp_extract_all`` beside ``split`` by the same expression: a match starts
after the pieces and matches before it. The expressions are forms of the stated ones that find the
same leftmost matches in linear time: possessive where the next symbol cannot be matched by what
precedes it, and with a look-behind that skips starts inside a run (``\\G`` lets a match begin where
the last one ended).

Edge cases: null and empty texts have no spans; spans of different kinds may overlap; repeated rows
and null doc_ids are kept as rows of their own; an empty table gives no rows; extra columns are
ignored. A pattern's words are looked for in the 80 characters
before and after an entity; one with fewer words there has fewer patterns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import checked, table, written

KINDS = ["email", "ip", "card", "phone"]
LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # maximal runs of 16 to 19 digits: the only matches of [0-9]([\x20-]?[0-9])+ that are kept
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?+[0-9]){15,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap tests that texts with a match pass.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){15}", "phone": "+"}
#: Tokens that may be identifiers.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: Digit groups joined by single separators, and tokens without a digit or @ that spell out an address.
GROUPS = r"(?<!\S)[+(]?[0-9]++(?:\)?[\x20./-]\(?[0-9]++)++"
SPELT = r"[\[({<](?i:at|dot)[\])}>]"
VEILED = rf"(?<!\S)[^\s0-9@]*?{SPELT}[^\s0-9@]*+(?!\S)"
CONTEXT_CHARS = 80
MIN_SEEDS = 5
MIN_CONFIDENCE = 0.6
Z = 3.0
#: Matches of a text whose positions are added up at a time.
RUN = 256
SPANS = "array<struct<s:int,e:int,t:string>>"


def let(value, body):
    """``body`` of a value that is worked out once."""
    return F.transform(F.array(value), body)[0]


def _placed(pairs, at):
    """(s, e, t) of (g, n, t), gap and length of each match, from position ``at`` on."""
    start = F.struct(at.alias("pos"), F.array().cast(SPANS).alias("out"))

    def step(acc, x):
        begin, end = acc["pos"] + x["g"], acc["pos"] + x["g"] + x["n"]
        return F.struct(end.alias("pos"), F.concat(acc["out"], F.array(F.struct(begin.alias("s"), end.alias("e"), x["t"].alias("t"))).cast(SPANS)).alias("out"))

    return F.aggregate(pairs, start, step, lambda acc: acc["out"])


def _placed_by_runs(pairs):
    """The same in runs of ``RUN`` matches: appending to one array takes time with the square of its length."""
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / RUN).cast("int")), lambda i: F.slice(pairs, i * RUN + 1, RUN))
    length = lambda r: F.aggregate(r, F.lit(0), lambda acc, x: acc + x["g"] + x["n"])
    first = F.struct(F.lit(0).alias("pos"), F.array().cast("array<int>").alias("out"))
    starts = lambda rs: F.aggregate(F.transform(rs, length), first, lambda acc, n: F.struct((acc["pos"] + n).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out")), lambda acc: acc["out"])
    return let(runs, lambda rs: F.flatten(F.zip_with(rs, starts(rs), _placed)))


def spans_of(text, pattern: str):
    """Array of (s, e, t): code point positions, end exclusive, and string of each match."""
    found, pieces = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, g: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("t")))
    return let(pairs, lambda p: F.when(F.size(p) <= RUN, _placed(p, F.lit(0))).otherwise(_placed_by_runs(p)))


def _digits(t):
    return F.regexp_replace(t, "[^0-9]", "")


def _luhn(t):
    d = _digits(t)

    def add(acc, i):
        x = F.substr(d, -i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return acc + F.when(x > 9, x - 9).otherwise(x)

    return F.length(d).between(16, 19) & (F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add) % 10 == 0)


def _octet(p):
    short = F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.when(F.length(short) > 3, False).otherwise(short.cast("int") <= 255)


KEEPS = {
    "email": None,
    "ip": lambda x: F.forall(F.split(x["t"], r"\."), _octet),
    "card": lambda x: _luhn(x["t"]),
    "phone": lambda x: F.length(_digits(x["t"])).between(8, 15),
}


def base_spans(text, kind: str):
    """The kept base matches of a kind."""
    hint = F.contains(text, F.lit(HINTS[kind])) if kind in ("email", "phone") else text.rlike(HINTS[kind])
    found = spans_of(text, PATTERNS[kind])
    if KEEPS[kind] is not None:
        found = F.filter(found, KEEPS[kind])
    return F.when(hint, found).otherwise(F.array().cast(SPANS))


def _word(w):
    """A word as patterns have it: lower-cased, bare of outer punctuation unless that is all, digits made equal."""
    bare = F.regexp_replace(F.lower(w), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    return F.regexp_replace(F.when(bare == "", w).otherwise(bare), "[0-9]", "0")


def _patterns(text, at, end):
    """The patterns of a mention: l1:word, l2:two words, r1:word after, lr:word before and after."""
    begin = F.greatest(at - CONTEXT_CHARS, F.lit(0))
    words = lambda part: F.transform(F.filter(F.split(part, r"\s+"), lambda w: w != ""), _word)
    left, right = words(F.substr(text, begin + 1, at - begin)), words(F.substr(text, end + 1, F.lit(CONTEXT_CHARS)))

    def of(c):
        l1, l2, r1 = F.get(F.reverse(c["l"]), 0), F.get(F.reverse(c["l"]), 1), F.get(c["r"], 0)
        return F.array_compact(F.array(F.concat(F.lit("l1:"), l1), F.concat(F.lit("l2:"), l2, F.lit(" "), l1), F.concat(F.lit("r1:"), r1), F.concat(F.lit("lr:"), l1, F.lit(" "), r1)))

    return let(F.struct(left.alias("l"), F.slice(right, 1, 1).alias("r")), of)


def scan(docs: DataFrame) -> DataFrame:
    """One pass over the texts, written: row, doc_id, key, the base spans by kind, mentions of them and of other tokens with their patterns, and ``loose`` ones that no confidence counts."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), F.md5(text).alias("key"))
    rows = rows.select("*", *[base_spans(F.col("text"), k).alias(k) for k in KINDS])
    every = F.concat(*KINDS)
    mention = lambda kind: lambda x: F.struct(kind.alias("kind"), x["s"].alias("s"), x["e"].alias("e"), x["t"].alias("t"), _patterns(F.col("text"), x["s"], x["e"]).alias("patterns"))
    seeds = F.concat(*[F.transform(k, mention(F.lit(k))) for k in KINDS])
    free = F.filter(spans_of(F.col("text"), TOKEN), lambda x: ~F.exists(F.col("_all"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    others = F.transform(free, mention(F.lit(None).cast("string")))
    # digit groups end where a base span begins
    starts = lambda x: F.transform(F.filter(F.col("_all"), lambda b: b["s"] > x["s"]), lambda b: b["s"])
    end = lambda x: F.least(x["e"], F.array_min(starts(x)))
    ends = F.transform(spans_of(F.col("text"), GROUPS), lambda x: F.struct(x["s"].alias("s"), end(x).alias("e"), F.substr(F.col("text"), x["s"] + 1, end(x) - x["s"]).alias("t")))
    groups = F.when(F.col("text").rlike(r"[0-9]\)?\x20\(?[0-9]"), F.filter(ends, lambda x: F.contains(x["t"], F.lit(" ")))).otherwise(F.array().cast(SPANS))
    veiled = F.when(F.col("text").rlike(SPELT), spans_of(F.col("text"), VEILED)).otherwise(F.array().cast(SPANS))
    outside = F.filter(F.concat(groups, veiled), lambda x: ~F.exists(F.col("_all"), lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    loose = F.transform(outside, mention(F.lit(None).cast("string")))
    rows = rows.withColumn("_all", every)
    mentions = F.when(F.col("text").rlike("[0-9@]"), F.concat(seeds, others))
    bare = [F.transform(k, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias(k) for k in KINDS]
    return written(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "key", *bare, mentions.alias("mentions"), loose.alias("loose")), "pii-scan")


def _suits(kind, token):
    """Whether a token's form may be of a kind that the base expressions miss."""
    n = F.length(_digits(token))
    return (
        F.when(kind == "email", token.rlike(r"@|(?i)[\[({<](at|dot)[\])}>]"))
        .when(kind == "ip", token.rlike(r"^[^0-9]*[0-9]+([.:,-][0-9]+){3}") | token.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"))
        .when(kind == "card", n.between(12, 19))
        .when(kind == "phone", n.between(7, 15))
        .otherwise(False)
    )


def _instance(t, kind):
    """What two mentions of one identifier have in common."""
    return F.when(kind.isin("card", "phone"), _digits(t)).otherwise(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]+$", ""))


def wilson(mean, n, z: float):
    """Lower end of the Wilson interval of a mean of n values in 0..1."""
    z2 = z * z
    return (mean + z2 / (2 * n) - z * F.sqrt(mean * (1 - mean) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def trusted_patterns(mentions: DataFrame, min_seeds: int, min_confidence: float, z: float) -> DataFrame:
    """Written (pattern, kind, trust) of the patterns that vouch, from mentions(kind, t, patterns), by iteration to a fixpoint.

    Scores only rise and patterns are only added, so it ends.
    """
    suits = F.filter(F.array(*map(F.lit, KINDS)), lambda k: _suits(k, F.col("t")))
    kinds = F.when(F.col("kind").isNull(), suits).otherwise(F.array("kind"))
    rows = mentions.select("patterns", "t", F.col("kind").isNotNull().alias("is_seed"), F.explode(kinds).alias("kind"))
    rows = rows.select("kind", _instance(F.col("t"), F.col("kind")).alias("inst"), "is_seed", F.explode("patterns").alias("pattern"))
    edges = written(rows.groupBy("pattern", "kind", "inst").agg(F.max("is_seed").alias("is_seed")), "pii-edges")
    seeds = edges.where("is_seed").select("kind", "inst", F.lit(1.0).alias("score")).distinct()
    scores, before, trusted = seeds, 0, None
    while True:
        stats = edges.join(scores, ["kind", "inst"], "left").groupBy("pattern", "kind").agg(F.count(F.lit(1)).alias("n"), F.count("score").alias("m"), F.avg(F.coalesce("score", F.lit(0.0))).alias("mean"))
        strong = stats.where(F.col("m") >= min_seeds).select("pattern", "kind", wilson(F.col("mean"), F.col("n"), z).alias("trust"))
        now = written(strong.where(F.col("trust") >= min_confidence), "pii-patterns")
        n = now.count()
        if n == before:
            return now if trusted is None else trusted
        trusted, before = now, n
        vouched = edges.join(now, ["pattern", "kind"]).groupBy("kind", "inst").agg(F.max("trust").alias("score"))
        scores = written(seeds.union(vouched).groupBy("kind", "inst").agg(F.max("score").alias("score")), "pii-scores")


def discovered(scanned: DataFrame, min_seeds: int = MIN_SEEDS, min_confidence: float = MIN_CONFIDENCE, z: float = Z) -> DataFrame:
    """(row, kind, s, e) of the spans that patterns vouch for, beside the base spans."""
    mentions = scanned.select("row", F.explode("mentions").alias("m")).select("row", "m.*")
    trusted = checked(trusted_patterns(mentions, min_seeds, min_confidence, z).withColumnRenamed("kind", "_kind"))
    kinded = lambda some: some.withColumn("pattern", F.explode("patterns")).join(trusted, "pattern")
    best = F.max_by("_kind", F.struct("trust", "_kind")).alias("kind")
    fresh = kinded(mentions.where("kind is null")).where(_suits(F.col("_kind"), F.col("t"))).groupBy("row", "s", "e").agg(best)
    whole = lambda least, most: F.regexp_extract("t", rf"^[+(]?(?:[0-9][^0-9]{{0,3}}){{{least - 1},{most - 1}}}[0-9](?![0-9])", 0)
    part = F.when(F.col("_kind") == "phone", whole(7, 15)).when(F.col("_kind") == "card", whole(12, 19)).when((F.col("_kind") == "email") & _suits(F.col("_kind"), F.col("t")), F.col("t"))
    loose = kinded(scanned.select("row", F.explode("loose").alias("m")).select("row", "m.*"))
    loose = loose.withColumn("e", F.col("s") + F.length(part)).where(F.length(part) > 0).groupBy("row", "s").agg(best, F.max_by("e", F.struct("trust", "_kind")).alias("e"))
    both = fresh.select("row", "kind", "s", "e").union(loose.select("row", "kind", "s", "e"))
    return both.groupBy("row", "kind", "s").agg(F.max("e").alias("e")).select("row", "kind", "s", "e")


def _joined(spans):
    order = F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"]))
    return F.array_join(order, ",")


def find_pii(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: row, doc_id, key, the base spans by kind, and ``more``, the discovered (kind, s, e)."""
    scanned = scan(docs)
    more = discovered(scanned).groupBy("row").agg(F.collect_set(F.struct("kind", "s", "e")).alias("more"))
    return scanned.drop("mentions", "loose").join(more, "row", "left")


def _kinded(kind: str):
    """The base spans of a kind as (s, e, kind)."""
    return F.transform(kind, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit(kind).alias("kind")))


def _more():
    """The discovered spans as (s, e, kind)."""
    found = F.coalesce(F.col("more"), F.array().cast("array<struct<kind:string,s:int,e:int>>"))
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))


def _of_kind(spans, kind: str):
    return F.array_sort(F.filter(spans, lambda x: x["kind"] == kind))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents"))
    base = _joined(F.concat(*[_kinded(k) for k in KINDS]))
    every = _joined(F.concat(*[_of_kind(F.concat(_kinded(k), _more()), k) for k in KINDS]))
    return found.select("doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS], F.sha2(base, 256).alias("base_sha256"), every.alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with each span, or run of overlapping spans, replaced by ``<KIND>`` of its first one."""
    found = find_pii(docs).dropDuplicates(["doc_id", "key"])
    spans = found.select(F.col("doc_id").alias("_tessera_id"), F.col("key").alias("_tessera_key"), F.array_sort(F.concat(*[_kinded(k) for k in KINDS], _more())).alias("_tessera_spans")).where(F.size("_tessera_spans") > 0)
    spans = checked(spans)
    keyed = docs.withColumn("_tessera_k", F.md5(F.coalesce("text", F.lit(""))))
    both = keyed.join(spans, F.col("doc_id").eqNullSafe(F.col("_tessera_id")) & (F.col("_tessera_k") == F.col("_tessera_key")), "left")
    text = F.col("text")
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        fresh = x["s"] >= acc["pos"]
        piece = F.concat(F.substr(text, acc["pos"] + 1, F.greatest(x["s"] - acc["pos"], F.lit(0))), F.lit("<"), F.upper(x["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["pos"], x["e"]).alias("pos"), F.when(fresh, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"]).alias("out"))

    done = F.aggregate("_tessera_spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substr(text, acc["pos"] + 1, F.length(text))))
    new = both.withColumn("text", F.when(F.col("_tessera_spans").isNull(), text).otherwise(done))
    return new.withColumn("n_chars", F.when(F.col("_tessera_spans").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)
