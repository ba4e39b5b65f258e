"""Secret scans: fixed patterns, and tokens that look random to a character model. DataFrame functions only.

Two Markov models of characters, one of random strings and one of ordinary
identifiers, are counted from labelled samples. A token's score is the sum over
its character pairs of the logarithm of the two models' probabilities. The
table of log ratios has SPAN x SPAN entries and is shipped as a literal.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

#: The patterns of the base rules, and the least length of a match (of group 2 for assign).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
ASSIGN_LEAST, ACCESS_LEAST = 8, 16
#: Tokens that the models judge.
TOKEN = r"[A-Za-z0-9+/_=-]{20,}"
#: Characters of tokens lie in FIRST .. FIRST + SPAN - 1.
FIRST, SPAN = 43, 80
#: Words of ordinary identifiers, for the labelled sample.
WORDS = (
    "user account order item price total count index value name type list map set get add remove update delete create "
    "read write open close file path line text word page site home main test data base table column row key query result "
    "error message time date start end first last next previous parent child node edge graph tree event handler service "
    "client server request response config option default internal public static final string number boolean object"
).split()


#: Matches whose lengths are added up at once, and characters of a token scored at once.
BLOCK, CHUNK = 64, 1024


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """`df` with columns that are computed once a row, also where lambdas use them for each element of an array.

    Projections in a row are merged, which would put the expressions into the lambdas; a generator keeps them apart.
    """
    one = F.explode(F.array(F.struct(*(c.alias(k) for k, c in columns.items()))))
    return df.select("*", one.alias("_one")).select(*(c for c in df.columns if c not in columns), *(F.col("_one")[k].alias(k) for k in columns))


def matches(df: DataFrame, text: str, patterns: dict[str, tuple[str, Column | None]]) -> DataFrame:
    """`df` with a column array<struct<start, end, has>> for each of `patterns`: all leftmost non-overlapping matches.

    Places are code points, ends exclusive. Splitting by a pattern gives what
    stands between the matches; lengths of both, added up, give the places: by
    blocks, so that time grows with the number of matches. A pattern may come
    with a test that a text must pass to be searched.
    """
    found, gaps = {}, {}
    for name, (pattern, test) in patterns.items():
        there = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        between = F.transform(F.split(text, pattern), F.length)
        if test is not None:
            there, between = F.when(test, there).otherwise(F.array().cast("array<string>")), F.when(test, between).otherwise(F.array().cast("array<int>"))
        found[f"{name}_has"], gaps[f"{name}_gap"] = there, between
    df = settled(df, **found, **gaps).drop(text)
    steps = {f"{k}_step": F.zip_with(F.slice(f"{k}_gap", 1, F.size(f"{k}_has")), f"{k}_has", lambda g, m: g + F.length(m)) for k in patterns}
    df = settled(df, **steps)
    total = lambda part: F.aggregate(part, F.lit(0), lambda x, y: x + y)

    def before(k: str) -> Column:
        """Code points before each block."""
        blocks = F.sequence(F.lit(0), F.floor(F.size(f"{k}_step") / BLOCK).cast("int"))
        sums = F.transform(blocks, lambda b: total(F.slice(f"{k}_step", b * BLOCK + 1, F.lit(BLOCK))))
        empty = F.array(F.lit(0))
        return F.aggregate(sums, empty, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))

    df = settled(df, **{f"{k}_before": before(k) for k in patterns})

    def placed(k: str) -> Column:
        def one(m: Column, i: Column) -> Column:
            block = F.floor(i / BLOCK).cast("int")
            own = total(F.slice(f"{k}_step", block * BLOCK + 1, i - block * BLOCK))
            start = F.get(f"{k}_before", block) + own + F.get(f"{k}_gap", i)
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("has"))

        return F.transform(f"{k}_has", one)

    out = settled(df, **{k: placed(k) for k in patterns})
    return out.drop(*(f"{k}_{x}" for k in patterns for x in ("has", "gap", "step", "before")))


def below(values: str, x: Column) -> Column:
    """How many of an ascending array column's values are below x, by bisection."""
    start = F.struct(F.lit(0).alias("lo"), F.size(values).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        middle = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        less = F.get(values, middle) < x
        done = acc["lo"] >= acc["hi"]
        return F.struct(
            F.when(~done & less, middle + 1).otherwise(acc["lo"]).alias("lo"), F.when(done | less, acc["hi"]).otherwise(middle).alias("hi")
        )

    turns = F.sequence(F.lit(0), F.ceil(F.log2(F.size(values) + 1)).cast("int"))
    return F.aggregate(turns, start, halve, lambda acc: acc["lo"])


def labelled_samples(spark: SparkSession, rows: int = 4000) -> DataFrame:
    """(token, secret): random strings in base64, base62 and hex, and identifiers in five styles.

    A fixed table that doesn't depend on the documents.
    """
    ids = spark.range(rows)
    digest = lambda salt: F.unhex(F.sha2(F.concat(F.lit(salt), F.col("id").cast("string")), 256))
    b64 = F.base64(digest("random"))
    random = F.element_at(
        F.array(b64, F.regexp_replace(b64, "[+/=]", "x"), F.lower(F.hex(digest("hex"))), F.translate(b64, "+/", "-_")),
        (F.col("id") % 4 + 1).cast("int"),
    )
    words = F.array(*(F.lit(w) for w in WORDS))
    pick = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(WORDS))) + 1).cast("int"))
    four = [pick(k) for k in range(4)]
    number = F.when(F.col("id") % 3 == 0, (F.col("id") % 90 + 10).cast("string")).otherwise("")
    plain = F.element_at(
        F.array(
            F.concat_ws("_", *four),
            F.concat(four[0], *(F.initcap(w) for w in four[1:])),
            F.concat_ws("-", *four),
            F.concat_ws("/", *four),
            F.upper(F.concat_ws("_", *four)),
        ),
        (F.col("id") % 5 + 1).cast("int"),
    )
    return ids.select(random.alias("token"), F.lit(True).alias("secret")).unionByName(
        ids.select(F.concat(plain, number).alias("token"), F.lit(False).alias("secret"))
    )


def _ordinary_words(docs: DataFrame, sample_docs: int) -> DataFrame:
    """Words of letters from the `sample_docs` rows of least key, as ordinary tokens; not parts of longer tokens."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    few = docs.select(text_of().alias("text"), key.alias("key")).orderBy("key", "text").limit(sample_docs)
    return few.select(F.explode(F.regexp_extract_all("text", F.lit("(?<![A-Za-z0-9+/_=-])[A-Za-z]{4,19}(?![A-Za-z0-9+/_=-])"), F.lit(0))).alias("token"), F.lit(False).alias("secret"))


def _pairs(token: Column) -> Column:
    """Numbers of a token's character pairs."""
    chars = F.transform(F.split(token, ""), lambda c: F.ascii(c) - FIRST)
    return F.zip_with(
        F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda a, b: a * SPAN + b
    )


def log_ratios(samples: DataFrame, smoothing: float = 0.5) -> list[float]:
    """SPAN x SPAN natural logarithms of P(next | this) among secrets over that among ordinary tokens."""
    counts = samples.filter(F.length("token") > 1).select("secret", F.explode(_pairs(F.col("token"))).alias("pair"))
    seen = {(r["secret"], r["pair"]): r["n"] for r in counts.groupBy("secret", "pair").agg(F.count("*").alias("n")).collect()}
    rows = {(s, a): sum(seen.get((s, a * SPAN + b), 0) for b in range(SPAN)) for s in (True, False) for a in range(SPAN)}

    def chance(secret: bool, a: int, b: int) -> float:
        return (seen.get((secret, a * SPAN + b), 0) + smoothing) / (rows[secret, a] + smoothing * SPAN)

    return [round(math.log(chance(True, a, b) / chance(False, a, b)), 3) for a in range(SPAN) for b in range(SPAN)]


def scorer(ratios: list[float]):
    """Column -> Column: the log likelihood ratio of a token, of ASCII characters."""
    literal = F.expr(f"array({','.join(f'{x!r}D' for x in ratios)})")

    def score(token: Column) -> Column:
        raw = token.cast("binary")  # whose parts are cut out without counting characters
        chunks = F.sequence(F.lit(0), F.floor(F.greatest(F.length(token) - 2, F.lit(0)) / CHUNK).cast("int"))
        own = lambda part: F.aggregate(
            _pairs(part), F.lit(0.0), lambda acc, pair: acc + F.coalesce(F.get(literal, pair), F.lit(0.0))
        )
        return F.aggregate(chunks, F.lit(0.0), lambda acc, c: acc + own(F.substr(raw, c * CHUNK + 1, F.lit(CHUNK + 1)).cast("string")))

    return score


def find_secrets(docs: DataFrame, sample_docs: int = 200, least: float = 14.0, least_mean: float = 0.6) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans for each row of `docs`.

    The base rules come first and are all kept. Tokens that touch no base span,
    hold a digit and a letter, and score at least `least` in all and
    `least_mean` a character pair are added as kind `markov`. The models are
    counted from `labelled_samples` and the words of `sample_docs` documents.
    Null texts are empty and have no spans; repeated rows are each scanned;
    only doc_id and text are read. Time grows with a text's length, however many
    matches it holds or how long they are.
    """
    spark = docs.sparkSession
    score = scorer(log_ratios(labelled_samples(spark).unionByName(_ordinary_words(docs, sample_docs))))
    text = F.col("_text")
    scan = docs.select("doc_id", text_of().alias("_text"))
    # the cheap test for a keyword spares most rows the search
    scan = matches(scan, "_text", {
        "assign": (ASSIGN, text.rlike("(?i)pass|secret|token|api_?key")), "access": (ACCESS, F.contains(text, F.lit("AKIA"))),
        "hex": (HEX, None), "token": (TOKEN, None),
    })
    kinds = ("assign", "access", "hex")
    scan = settled(
        scan,
        assign=F.filter("assign", lambda m: F.length(F.regexp_extract(m["has"], ASSIGN, 2)) >= ASSIGN_LEAST),
        access=F.filter("access", lambda m: F.length(m["has"]) >= ACCESS_LEAST),
    )
    # spans of one kind don't overlap, so both their starts and their ends ascend
    scan = settled(scan, **{f"{k}_{x}": F.col(f"{k}.{x}") for k in kinds for x in ("start", "end")})

    def touches(m: Column) -> Column:
        out = F.lit(False)
        for k in kinds:
            last = below(f"{k}_start", m["end"]) - 1
            out = out | ((F.size(k) > 0) & (last >= 0) & (F.get(f"{k}_end", last) > m["start"]))
        return out

    likely = lambda m: (
        m["has"].rlike("[0-9]") & m["has"].rlike("[A-Za-z]") & ~touches(m)
        & (score(m["has"]) >= F.greatest(F.lit(least), F.lit(least_mean) * (F.length(m["has"]) - 1)))
    )
    named = lambda kind, order: F.transform(kind, lambda m: F.struct(m["start"].alias("start"), F.lit(order).alias("kind"), m["end"].alias("end")))
    scan = settled(scan, base=F.array_sort(F.concat(*(named(k, i) for i, k in enumerate(kinds)))), markov=named(F.filter("token", likely), 3))
    names = F.array(*(F.lit(k) for k in (*kinds, "markov")))
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    return scan.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in (*kinds, "markov")),
        F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "markov"))).alias("spans"),
    )


def op9_secrets(spark, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
