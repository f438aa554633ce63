"""Secret scans: fixed patterns, and character Markov models for the rest.

Two first-order Markov models over characters, one of random strings and one
of ordinary identifiers, are trained from labelled samples.  A token whose
log-likelihood ratio is high enough, in the mean and in all, is reported as
``random``.  Everything on
the rows is DataFrame functions: positions come from the lengths of the pieces
between the matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base patterns.  Kinds in order of listing.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")
ASSIGN_LEAST = 6

#: Ten characters of 62 are 59 bits, what can just be tried out; a shorter random string hides nothing.
TOKEN = r"[A-Za-z0-9+/_=-]{10,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIDE = len(ALPHABET) + 1  # place 0 is any other character
#: Mean log-likelihood ratio of a character from which a token is random.
THRESHOLD = 1.5
#: Log-likelihood ratio that a token must have in all, so that short ones need more in the mean.
EVIDENCE = 22.5
CHUNK = 512

#: Words that identifiers are made of, for the labelled samples.
PARTS = (
    "account action active address agent array asset balance batch binary block buffer build cache callback channel character "
    "client cluster column command component config connection context controller counter create cursor customer database default "
    "description device directory display document domain driver element encode engine entity error event exception execute export "
    "factory feature filter folder format frame function gateway generate global handler header helper history identifier image "
    "import index initial instance interface internal invoice iterator language layer length library listener location logger "
    "manager mapping matrix member memory message method metric module monitor network number object offset operation order "
    "package page parser partition password pattern pipeline pointer position private process project property provider query "
    "queue reader record register report request response result router schema script search secret section sequence server "
    "session setting signal source state storage stream string structure system table target template thread timeout transform "
    "update user utility value variable vector version virtual window worker writer "
    "gesellschaft einheit wirtschaft verantwortung entwicklung untersuchung beziehungsweise geschwindigkeit zusammenarbeit "
    "schließlich ungerechtigkeit gemeinschaft entscheidung veröffentlichung aufmerksamkeit "
    "gouvernement développement établissement enseignement quelque aujourd beaucoup toujours environnement heureusement "
    "desarrollo conocimiento universidad generalmente trabajo ciudad movimiento administración importante siguiente"
).split()


def labelled_samples(spark: SparkSession, n: int = 20000) -> DataFrame:
    """``n`` rows (token, is_random) of either label, made by rule and the same on every run.

    Random strings are digests in base 64, with and without signs, and in
    upper, lower or mixed letters and digits; identifiers are two to four words
    in snake, kebab, camel or upper case, some with a number.
    """
    i = F.col("id")
    h = lambda salt: F.xxhash64("id", F.lit(salt))
    raw = F.base64(F.unhex(F.sha2(F.concat(F.lit("sample"), i.cast("string")), 384)))
    kind = F.pmod(h(1), F.lit(5))
    plain = F.regexp_replace(raw, "[+/=]", "")
    token = F.when(kind == 0, raw).when(kind <= 2, plain).when(kind == 3, F.when(i % 2 == 0, F.upper(plain)).otherwise(F.lower(plain)))
    token = F.substring(token.otherwise(F.sha2(i.cast("string"), 256)), 1, 40)
    words = F.array(*map(F.lit, PARTS))
    picks = [F.element_at(words, (F.pmod(h(10 + k), F.lit(len(PARTS))) + 1).cast("int")) for k in range(4)]
    some = F.slice(F.array(*picks), 1, (F.pmod(h(2), F.lit(3)) + 2).cast("int"))
    style = F.pmod(h(3), F.lit(5))
    name = F.when(style == 0, F.array_join(some, "_")).when(style == 1, F.array_join(some, "-")).when(style == 2, F.upper(F.array_join(some, "_")))
    name = name.when(style == 3, F.array_join(F.transform(some, F.initcap), "")).otherwise(F.array_join(some, "/"))
    name = F.when(F.pmod(h(4), F.lit(4)) == 0, F.concat(name, F.pmod(h(5), F.lit(1000)).cast("string"))).otherwise(name)
    ids = spark.range(n)
    return ids.select(token.alias("token"), F.lit(True).alias("is_random")).unionByName(ids.select(name.alias("token"), F.lit(False).alias("is_random")))


def _places(token: Column) -> Column:
    return F.transform(F.split(token, ""), lambda c: F.when(c == "", 0).otherwise(F.instr(F.lit(ALPHABET), c)))


def train(samples: DataFrame) -> list[float]:
    """Log ratios by (character, next character), row by row; ``samples`` has token and is_random.

    Only the counts of character pairs, at most 2 * SIDE**2 numbers, reach the
    driver.  Null tokens and labels are ignored.
    """
    rows = samples.where("token is not null and is_random is not null").withColumn("at", _places(F.col("token")))
    n = F.size("at")
    pairs = F.zip_with(F.slice("at", 1, F.greatest(n - 1, F.lit(0))), F.slice("at", 2, F.greatest(n - 1, F.lit(0))), lambda a, b: a * SIDE + b)
    counted = rows.select("is_random", F.explode(pairs).alias("pair")).groupBy("is_random", "pair").count().collect()
    counts = {True: [0.5] * SIDE**2, False: [0.5] * SIDE**2}
    for label, pair, c in counted:
        counts[label][pair] += c
    log = {}
    for label, c in counts.items():
        sums = [sum(c[a * SIDE : (a + 1) * SIDE]) for a in range(SIDE)]
        log[label] = [math.log(x / sums[k // SIDE]) for k, x in enumerate(c)]
    return [a - b for a, b in zip(log[True], log[False])]


def log_ratio(token: Column, table: list[float]) -> Column:
    """Log-likelihood ratio of a token's transitions under the two models, summed in order."""
    ratios = F.split(F.lit(",".join(f"{x:.3f}" for x in table)), ",").cast("array<double>")
    at = _places(token)
    inner = F.zip_with(F.slice(at, 1, F.size(at) - 1), F.slice(at, 2, F.size(at) - 1), lambda a, b: F.element_at(ratios, a * SIDE + b + 1))
    return F.aggregate(inner, F.lit(0.0), lambda s, x: s + x)


def _running(steps: Column) -> Column:
    """Spans (s, e) of the good steps (step, width, good), by two levels of running sums.

    Sums within chunks and then over chunks, so a text with very many matches
    costs little more than linear time.
    """
    none = F.expr("array()").cast("array<struct<s:int,e:int>>")

    def within(part: Column) -> Column:
        def add(acc: Column, x: Column) -> Column:
            at = acc.at + x.step
            more = F.concat(acc.out, F.array(F.struct((at - x.width).cast("int").alias("s"), at.cast("int").alias("e"))))
            return F.struct(at.alias("at"), F.when(x.good, more).otherwise(acc.out).alias("out"))

        return F.aggregate(part, F.struct(F.lit(0).alias("at"), none.alias("out")), add)

    def over(acc: Column, x: Column) -> Column:
        moved = F.transform(x.out, lambda y: F.struct((y.s + acc.at).alias("s"), (y.e + acc.at).alias("e")))
        return F.struct((acc.at + x.at).alias("at"), F.concat(acc.out, F.array(moved)).alias("out"))

    starts = F.sequence(F.lit(1), F.size(steps), F.lit(CHUNK))
    parts = F.transform(starts, lambda c: within(F.slice(steps, c, F.lit(CHUNK))))
    many = F.expr("array()").cast("array<array<struct<s:int,e:int>>>")
    found = F.aggregate(parts, F.struct(F.lit(0).alias("at"), many.alias("out")), over, lambda acc: F.flatten(acc.out))
    return F.when(F.size(steps) > 0, found).otherwise(none)


def _spans(text: Column, pattern: str, kind: int, good) -> Column:
    """Sorted spans (s, k, e) of the matches of ``pattern`` that are ``good``."""
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == 0 else hits
    pieces = F.split(text, pattern, -1)
    both = F.arrays_zip(F.slice(pieces, 1, F.size(hits)).alias("p"), hits.alias("h"), inner.alias("i"))
    steps = F.transform(
        both,
        lambda x: F.struct((F.length(x["p"]) + F.length(x["h"])).alias("step"), F.length(x["h"]).alias("width"), good(x["i"]).alias("good")),
    )
    return F.transform(_running(steps), lambda x: F.struct(x.s.alias("s"), F.lit(kind).alias("k"), x.e.alias("e")))


def _listed(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x.k + 1), x.s.cast("string"), x.e.cast("string"))), ",")


def scan(docs: DataFrame, table: list[float], threshold: float = THRESHOLD, evidence: float = EVIDENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the arrays of spans (s, k, e) ``base`` and ``found`` of every row.

    Spans count code points, the end exclusive; ``k`` is the place in KINDS.
    ``base`` has the spans of the fixed patterns, ``found`` these and the
    ``random`` tokens, which may overlap them, by start and then kind.  A null
    text is an empty one; rows are judged one by one, so repeated rows repeat
    their result.  Other columns are not read.
    """
    text = F.col("text")
    none = F.expr("array()").cast("array<struct<s:int,k:int,e:int>>")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    always = lambda x: F.lit(True)

    def found(pattern: str, kind: int, good) -> Column:
        return F.when(text.rlike(pattern), _spans(text, pattern, kind, good)).otherwise(none)

    rows = rows.select(
        "doc_id",
        found(ASSIGN, 0, lambda g: F.length(g) >= ASSIGN_LEAST).alias("a"),
        found(ACCESS, 1, always).alias("b"),
        found(HEX, 2, always).alias("c"),
        found(TOKEN, 3, lambda t: log_ratio(t, table) >= F.greatest(F.lit(evidence), (F.length(t) - 1) * threshold)).alias("d"),
    )
    rows = rows.select("*", F.sort_array(F.concat("a", "b", "c")).alias("base"))
    return rows.select("doc_id", "a", "b", "c", "d", "base", F.sort_array(F.concat("base", "d")).alias("found"))


def digest(scanned: DataFrame) -> DataFrame:
    """Counts by kind, the hash of the base spans, and all spans as text."""
    count = lambda c: F.size(c).cast("long")
    return scanned.select(
        "doc_id",
        count("a").alias("n_assign"),
        count("b").alias("n_access"),
        count("c").alias("n_hex"),
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"),
        _listed(F.col("found")).alias("spans"),
        count("d").alias("n_random"),
    )
