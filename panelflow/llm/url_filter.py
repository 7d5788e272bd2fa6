"""URL filter: rules first, then the ratio of two character language models learned from the URLs that rules decide."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelflow.session import stored

ORDER = 5  # characters of context, at most
EDGE = " "  # stands before a URL and ends it
ALPHABET = 256  # the model of order -1 gives every character 1 / ALPHABET
FOLDS = 5  # labelled pages of fold 0 calibrate, the others train
MICRO = 1_000_000  # log ratios are whole millionths of a nat, so sums do not depend on their order
STEP = 15_625  # width of a calibration bin in millionths: 1/64 nat
HOT = 1 << 16  # a gram with a share of 1 / HOT of all positions is hot; no more than HOT grams can be

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains and the paths that begin with `path`."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rules of the registered query.
RULES = (
    Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"),
    Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block"),
)


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first `://`, A-Z lower-cased) and path of a URL; both empty where it is null or has no `://`."""
    held = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(held, "://([^/?#]*)([^?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(held, "://([^/?#]*)([^?#]*)", 2)


def decided(host: Column, path: Column, rules: tuple[Rule, ...]) -> Column:
    """struct(rule, verdict) of the longest rule that fits (of equal ones that with the longer host, then by name); null if none does."""
    ranked = sorted(rules, key=lambda r: (-len(r.name), -len(r.host), r.name, r.verdict))
    whens = [
        F.when(((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path),
               F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict")))
        for r in ranked
    ]
    return F.coalesce(*whens) if whens else F.lit(None).cast("struct<rule:string,verdict:string>")


def fold(id_col: Column) -> Column:
    """Fold of a row: the first 8 hex digits of the md5 of its id as text, modulo FOLDS; a null id counts as empty."""
    digest = F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % FOLDS).cast("int")


def grams(text: Column, order: int = ORDER) -> Column:
    """The order + 1 characters that end at each character of the text and at its end mark."""
    padded = F.concat(F.lit(EDGE * order), text, F.lit(EDGE))
    return F.transform(F.sequence(F.lit(1), F.char_length(text) + 1), lambda i: F.substr(padded, i, F.lit(order + 1)))


def fit(urls: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, uses, ratio) from rows (text, accepted, rejected); ratio is ln P(accepted) - ln P(rejected) in millionths of a nat.

    All rows are counted: a row trains the accepted or the rejected model where the column says 1, and its
    grams are rated in any case. Both models interpolate over context lengths after Witten and Bell:
    P_k = (n + T P_(k-1)) / (N + T), with T the different characters seen after the context; a context
    never seen leaves P_(k-1), so the order varies with what was seen. Steps work on distinct grams;
    a context or a suffix meets at most as many of them as there are characters, so no key is hot.
    """
    counted = (
        urls.select(F.explode(grams(F.col("text"), order)).alias("gram"), "accepted", "rejected")
        .groupBy("gram").agg(F.count(F.lit(1)).alias("uses"), F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
    )
    counted = stored(counted, "url-grams")
    events = (
        counted.select(F.explode(F.sequence(F.lit(1), F.lit(order + 1))).alias("size"), "gram", "a", "r")
        .groupBy("size", F.expr("right(gram, size)").alias("event")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    )
    after = Window.partitionBy("size", F.expr("left(event, size - 1)"))
    totals = {f"{kind}_{c}": fn.over(after) for c in "ar" for kind, fn in
              (("all", F.sum(c)), ("types", F.sum((F.col(c) > 0).cast("long"))))}
    events = stored(events.withColumns(totals), "url-events")

    model = None
    for size in range(1, order + 2):
        level = events.filter(F.col("size") == size)
        if model is None:
            level = level.withColumns({"below_a": F.lit(1.0 / ALPHABET), "below_r": F.lit(1.0 / ALPHABET)})
        else:
            below = model.select(F.col("event").alias("suffix"), F.col("p_a").alias("below_a"), F.col("p_r").alias("below_r"))
            level = level.withColumn("suffix", F.expr("right(event, size - 1)")).join(below, "suffix")
        model = level.select("event", *[
            F.when(F.col(f"all_{c}") > 0, (F.col(c) + F.col(f"types_{c}") * F.col(f"below_{c}")) / (F.col(f"all_{c}") + F.col(f"types_{c}")))
            .otherwise(F.col(f"below_{c}")).alias(f"p_{c}") for c in "ar"])
    ratio = F.round((F.log("p_a") - F.log("p_r")) * MICRO).cast("long").alias("ratio")
    return stored(model.join(counted, model.event == counted.gram).select("gram", "uses", ratio), "url-model")


def scores(texts: DataFrame, model: DataFrame) -> DataFrame:
    """(text, total, places): the sum of the ratios of each distinct text and the number of its grams.

    Grams that hold 1 / HOT of all places or more, of which there are at most HOT, meet the texts in a
    broadcast of that bounded size; all others are shuffled, and none of them is frequent.
    """
    whole = model.agg(F.sum("uses")).first()[0] or 0
    hot = model.filter(F.col("uses") * HOT >= whole).select("gram", "ratio")
    cold = model.filter(F.col("uses") * HOT < whole).select("gram", "ratio")
    places = texts.select("text").distinct().select("text", F.explode(grams(F.col("text"))).alias("gram"))
    met = places.join(F.broadcast(hot), "gram", "left")
    partial = [F.sum("ratio").alias("total"), F.count(F.lit(1)).alias("places")]
    frequent = met.filter("ratio IS NOT NULL").groupBy("text").agg(*partial)
    rare = met.filter("ratio IS NULL").drop("ratio").join(cold.hint("shuffle_hash"), "gram").groupBy("text").agg(*partial)
    return frequent.unionByName(rare).groupBy("text").agg(F.sum("total").alias("total"), F.sum("places").alias("places"))


def bin_of(total: Column, places: Column) -> Column:
    return F.floor(total / places / F.lit(float(STEP)))


def calibrate(held: DataFrame) -> int:
    """The bin from which on URLs are accepted: the cut of rows (bin, accepted) with the best balanced accuracy.

    Of equally good cuts the nearest to 0, then the lower; 0 where one of the classes has no row. The bins,
    1/64 nat wide, are bounded by the models' range (some thousands), whatever the number of rows.
    """
    bins = sorted(tuple(r) for r in held.groupBy("bin").agg(F.sum("accepted"), F.sum(1 - F.col("accepted"))).collect())
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    if not good or not bad:
        return 0
    best, above, below = [], good, 0
    for at, yes, no in bins:  # accepted are those at or above the cut
        best.append((-(above * bad + below * good), abs(at), at))
        above, below = above - yes, below + no
    best.append((-(below * good), abs(bins[-1][0] + 1), bins[-1][0] + 1))
    return min(best)[2]


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per input row: id, host, path, rule, verdict, score_micronats.

    The longest fitting rule decides. Rule verdicts label their URLs (host and path) for the two models:
    four fifths of the labelled rows, by the md5 of the id, train, the rest calibrates the cut of the mean log
    ratio per character, and every URL without a rule is allowed at or above it. `rules` is a policy
    list held in the plan; labels and counts come from all rows of the table.

    Null URLs and URLs without `://` have an empty host and path and are judged as the empty text;
    without a labelled row of both classes the cut is 0. Repeated rows and ids are each judged, null ids pass through;
    an empty table gives an empty table; no further column is read. Equal texts are scored once.
    """
    host, path = parts(F.col(url_col))
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_by", decided(F.col("host"), F.col("path"), rules)).select(
        id_col, "host", "path", F.col("_by.rule").alias("rule"), F.col("_by.verdict").alias("_ruled"),
        F.concat("host", "path").alias("text"), fold(F.col(id_col)).alias("_fold"))
    trains = F.col("_fold") != 0
    allow = (trains & (F.col("_ruled") == "allow")).cast("long")
    block = (trains & (F.col("_ruled") == "block")).cast("long")
    urls = rows.select("text", F.coalesce(allow, F.lit(0)).alias("accepted"), F.coalesce(block, F.lit(0)).alias("rejected"))
    scored = scores(rows, fit(urls))
    rated = stored(rows.join(scored, "text").withColumn("bin", bin_of(F.col("total"), F.col("places"))), "url-scores")
    held = rated.filter("_fold = 0 AND _ruled IS NOT NULL").select("bin", (F.col("_ruled") == "allow").cast("long").alias("accepted"))
    cut = calibrate(held)
    method = F.when(F.col("bin") >= cut, "allow").otherwise("block")
    return rated.select(id_col, "host", "path", "rule", F.coalesce("_ruled", method).alias("verdict"),
                        F.floor(F.col("total") / F.col("places")).alias("score_micronats"))
