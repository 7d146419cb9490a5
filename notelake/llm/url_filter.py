"""URL filter, in DataFrame operations alone: host and path rules first, then logistic regression on hashed character n-grams.

The regression is fitted on a small labelled table of urls. Its gradient descent, with momentum, runs in one SQL expression over the
urls' Gram matrix: from zero weights, every step's weights are a combination of the labelled urls' features, so a coefficient per url is
all it carries. Features are n-gram counts by how rare an n-gram is in the table, scaled by their length over a url's n-grams; what the
table doesn't know adds to the length alone, so unknown names tend to the verdict of most labelled urls, to be allowed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 16_384
SIZES = (3, 4)
ROUNDS = 200  # by which no score changes in the second digit
RIDGE = 0.0001

#: Fixed values of the query's contract.
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]

#: The small labelled table: names of sites that a reader would keep, and of others. Each becomes a url.
KEPT_SITES = """
    wiki garden news docs library recipes weather museum forum university travel hardware medicine school orchestra software cinema
    town science census radio farm dictionary seminar history nation theatre mathematics printing bakery railway harbour mountain
    literature teaching nursing parish village history-of-rome street-maps city-council public-health open-source data-archive
    law-journal physics-notes language-course chess-club rowing-club choir photography astronomy botany geology chemistry biology
    economics philosophy poetry novels comics painting sculpture architecture carpentry knitting cooking cycling hiking sailing
    climbing running swimming football tennis cricket marathon festival concert gallery exhibition conference workshop lecture
    research institute academy college kindergarten hospital clinic dentist pharmacy-school police fire-brigade post-office bank
    insurance-advice housing transport airport station bus-timetable ferry weather-radar earthquake-watch bird-watching fishing
    forestry agriculture market grocer butcher florist tailor plumber electrician mechanic engineer developer tutorial manual
    reference glossary encyclopedia magazine newspaper journal bulletin archive podcast television studio theatre-group
    """.split()
#: What is sold or done on sites that a reader would not keep, and the words around it: a blocked name has one of each.
_GOODS = """casino poker slots roulette lottery betting viagra cialis porn xxx nude escort webcam replica rolex warez keygen crack payday loans
    forex bitcoin backlinks popups spamming adserver adult pills bets ads spam""".split()
_AROUND = "online best cheap free fast hot bonus direct vip deals".split()
BLOCKED_SITES = [f"{a}-{g}" if (i + k) % 2 else f"{g}-{a}" for i, g in enumerate(_GOODS) for k in range(5) for a in (_AROUND[(3 * i + 2 * k + k // 5) % len(_AROUND)],)]

#: Prefix, domain and path of urls: most are the same for both labels, some only one has.
_FORMS = [("", "com", "/en/1204.html"), ("www.", "net", "/fr/88"), ("m.", "org", "/index"), ("blog.", "com", "/de/7/"), ("", "org", "/es/301.html")]
_KEPT_FORMS = [("", "org", "/about/history.html"), ("docs.", "com", "/archive/2019/notes")]
_BLOCKED_FORMS = [("", "com", "/offer/claim-now"), ("www.", "net", "/click/redirect/win")]


def labelled(sites: list[str], own: list[tuple[str, str, str]]) -> list[str]:
    forms = _FORMS + own
    return [f"{p}{site}.example.{d}{path}" for i, site in enumerate(sites) for p, d, path in (forms[i % len(forms)],)]


ALLOWED, BLOCKED = labelled(KEPT_SITES, _KEPT_FORMS), labelled(BLOCKED_SITES, _BLOCKED_FORMS)


def parse(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null or without '://'."""
    from .decontam import _LOWER, _UPPER

    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule, what in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        at, _, rest = rule.partition("/")
        fits = ((host == at) | host.endswith("." + at)) & path.startswith("/" + rest)
        name, verdict = F.when(fits, rule).otherwise(name), F.when(fits, what).otherwise(verdict)
    return name, verdict


def grams(text: Column) -> Column:
    """Buckets of a text's character n-grams, with repeats; every digit counts as 0. A pattern that looks ahead finds them in one pass."""
    text = F.regexp_replace(text, "[0-9]", "0")
    found = F.concat(*(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}})).")) for n in SIZES))
    return F.transform(found, lambda g: F.pmod(F.xxhash64(g), F.lit(BUCKETS)).cast("int"))


@dataclass
class Model:
    """Weights and squared rarity by bucket, and the bias: 2 * BUCKETS + 1 numbers, whatever the input."""

    weights: list[float]
    rarity: list[float]
    bias: float


def _numbers(values: list[float]) -> Column:
    """An array that is one literal to the planner, not thousands."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")


def fit(spark: SparkSession, allowed=ALLOWED, blocked=BLOCKED, rounds: int = ROUNDS) -> Model:
    n = len(allowed) + len(blocked)
    if not n:
        return Model([0.0] * BUCKETS, [0.0] * BUCKETS, 0.0)
    urls = spark.range(0, 1, 1, 1).select(F.posexplode(F.lit([*allowed, *blocked])).alias("i", "url"))
    urls = urls.withColumn("y", (F.col("i") >= len(allowed)).cast("double"))
    x = urls.select("i", F.explode(grams(F.col("url"))).alias("b")).groupBy("i", "b").count()
    rare = x.groupBy("b").agg(F.log(n / F.count("*")).alias("idf"))  # what most urls have tells nothing
    x = x.join(rare, "b")
    size = x.groupBy("i").agg(F.sqrt(F.sum(F.col("count") * F.col("idf") * F.col("idf"))).alias("size"))
    x = x.join(size, "i").select("i", "b", "idf", F.coalesce(F.try_divide(F.col("count") * F.col("idf"), "size"), F.lit(0.0)).alias("x"))
    gram = x.alias("p").join(x.alias("q"), "b").groupBy(F.col("p.i").alias("i"), F.col("q.i").alias("j")).agg(F.sum(F.col("p.x") * F.col("q.x")).alias("k"))
    gram = gram.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "k"))).alias("ks"))
    rows_of = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda j: 1 + F.coalesce(F.try_element_at("ks", j), F.lit(0.0)))
    table = urls.join(gram, "i", "left").withColumn("ks", F.coalesce("ks", F.expr("cast(map() as map<int,double>)"))).select(F.struct("i", "y", rows_of.alias("k")).alias("r"))
    one = table.agg(F.array_sort(F.collect_list("r")).alias("rows"))
    # No row of the Gram matrix sums up to more than this, so no step is too long.
    one = one.withColumn("step", F.expr(f"1 / ({RIDGE} + 0.25 / {n} * array_max(transform(rows, r -> aggregate(r.k, cast(0 as double), (s, v) -> s + abs(v)))))"))
    zero = "transform(rows, r -> cast(0 as double))"
    gradient = f"{RIDGE} * s.z[i] - (r.y - 1 / (1 + exp(-aggregate(zip_with(r.k, s.z, (p, q) -> p * q), cast(0 as double), (u, v) -> u + v)))) / {n}"
    descend = f"""
        aggregate(sequence(1, {rounds}), struct({zero} as a, {zero} as z, cast(1 as double) as t),
            (s, k) -> transform(array(struct(transform(rows, (r, i) -> s.z[i] - step * ({gradient})) as a, (1 + sqrt(1 + 4 * s.t * s.t)) / 2 as t)),
                m -> struct(m.a as a, zip_with(m.a, s.a, (p, q) -> p + (s.t - 1) / m.t * (p - q)) as z, m.t as t))[0],
            s -> s.a)
    """
    alpha = one.select(F.posexplode(F.expr(descend)).alias("i", "alpha"))
    weights = x.join(alpha, "i").groupBy("b").agg(F.sum(F.col("x") * F.col("alpha")).alias("w"), F.max("idf").alias("idf"))
    out = Model([0.0] * BUCKETS, [math.log(n) ** 2] * BUCKETS, 0.0)
    for r in weights.unionByName(alpha.agg(F.lit(BUCKETS).cast("bigint").alias("b"), F.sum("alpha").alias("w"), F.lit(0.0).alias("idf"))).collect():
        if r["b"] == BUCKETS:
            out.bias = r["w"]
        else:
            out.weights[r["b"]], out.rarity[r["b"]] = r["w"] * r["idf"], r["idf"] ** 2
    return out


def score(text: Column, model: Model) -> Column:
    """The probability that a url, host and path joined, is to be blocked."""
    weights, rarity = _numbers(model.weights), _numbers(model.rarity)
    total = lambda bs, numbers: F.aggregate(bs, F.lit(0.0), lambda s, b: s + F.get(numbers, b))
    margin = F.transform(F.array(grams(text)), lambda bs: F.try_divide(total(bs, weights), F.sqrt(total(bs, rarity))))  # in an array, so that the n-grams are made once
    return 1 / (1 + F.exp(-F.coalesce(F.get(margin, F.lit(0)), F.lit(0.0)) - F.lit(model.bias)))


def judge(pages: DataFrame, rules=RULES, allowed=ALLOWED, blocked=BLOCKED) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) per row of pages.

    A null url, and one without '://', has an empty host and path, fits no rule and is judged by the model's bias alone, which allows it. Ties between
    rules of one length can't occur for one url unless they are equal. Urls are taken whole; repeated rows are judged each; an empty
    table gives no rows; other columns aren't read. At a score of 0.5 a url is blocked.
    """
    model = fit(pages.sparkSession, allowed, blocked)
    host, path = parse(F.col("url"))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("own"), score(F.concat("host", "path"), model).alias("score"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("own", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
