"""Secret scan: candidate strings judged by a random forest, all in DataFrame operations.

Candidates are long runs of token characters that hold a digit. Length, character transitions, dictionary
coverage, path shape and neighbouring words are column expressions over a candidate and its
surroundings. A random forest, trained by Spark ML on labelled findings, is written out as one
expression per tree, so whole texts are scanned, judged and redacted in one pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bizcontacts.operators.contacts import pin

TOKEN = "A-Za-z0-9+/=_\\-"
CANDIDATE = f"(?<![{TOKEN}])(?=[A-Za-z+/=_\\-]*+[0-9])[{TOKEN}]{{16,}}+"
AROUND = 48
REDACTED = "[SECRET]"
TREES, DEPTH = 15, 5
THRESHOLD = 0.5
# Fixed word lists of the features.
DICTIONARY = ("about after again example file from have hello home image index info into key lorem main message "
              "name order other page password sample secret service some test that the this token user value "
              "version was what when where which with world your").split()
KEY_WORDS = "token|secret|passw|passwd|pwd|api[_-]?key|access[_-]?key|auth|bearer|credential|private"
HARMLESS_WORDS = "sha\\d*|md5|hash|commit|digest|checksum|uuid|guid|card|order|invoice|example|sample|test|isbn|phone"


def features(value: Column, left: Column, right: Column) -> dict[str, Column]:
    """Numbers that describe a candidate, by name."""
    size = F.length(value)
    low = F.lower(value)
    lowers, uppers, digits = (F.length(F.regexp_replace(value, f"[^{c}]+", "")) for c in ("a-z", "A-Z", "0-9"))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(
        value, "[^A-Za-z0-9]+", "-"), "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "0")
    words = F.length(F.regexp_replace(low, "|".join(DICTIONARY), ""))
    tail, head = F.lower(F.right(left, F.lit(24))), F.lower(F.left(right, F.lit(24)))
    return {
        "size": size.cast("double"),
        "transitions": F.length(classes) / size,
        "lower": lowers / size, "upper": uppers / size, "digit": digits / size,
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / size,
        "hex": low.rlike("^[0-9a-f]+$").cast("double"),
        "dictionary": 1 - words / size,
        "path": (value.rlike("/[A-Za-z0-9_-]*/") | left.rlike("(://|/|\\\\)\\S*$") | right.rlike("^(/|\\.[a-z]{2,4}\\b)"))
        .cast("double"),
        "key_word": tail.rlike(f"({KEY_WORDS})\\w*[\"' ]*[:=]?>?[ \"']*$").cast("double"),
        "harmless_word": (tail.rlike(f"({HARMLESS_WORDS})\\W*$") | head.rlike(f"^\\W*({HARMLESS_WORDS})")).cast("double"),
        "assigned": left.rlike("[:=]\\s*[\"']?$").cast("double"),
        "quoted": (left.rlike("[\"'`]$") & right.rlike("^[\"'`]")).cast("double"),
    }


def labelled_findings(spark: SparkSession, rows: int = 4_000) -> DataFrame:
    """Labelled findings (value, left, right, label) to train on where no reviewed ones are at hand.

    Drawn by hash from common forms: keys, tokens and passwords in assignments and headers against
    digests, card and order numbers, ids, paths, placeholders and prose.
    """
    h = lambda k: F.abs(F.xxhash64("id", F.lit(k)))
    pick = lambda k, *xs: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]),
                                       (h(k) % len(xs) + 1).cast("int"))
    seed = F.concat(F.lit("s"), F.col("id").cast("string"))
    hexes = F.substring(F.sha2(seed, 512), 1, 128)
    base = F.regexp_replace(F.base64(F.unhex(F.sha2(seed, 512))), "\\s", "")
    cut = lambda c, k, low, high: c.substr(F.lit(1), (h(k) % (high - low) + low).cast("int"))
    digits = F.regexp_replace(F.conv(F.substring(F.sha2(seed, 256), 1, 15), 16, 10), "^0+", "")
    secret = pick(1, F.substring(hexes, 1, 32), F.substring(hexes, 1, 40), F.upper(F.substring(hexes, 1, 40)),
                  F.substring(hexes, 1, 64), cut(base, 2, 20, 64), F.concat(F.lit("sk-"), cut(base, 3, 24, 48)))
    key = pick(4, "token", "secret", "api_key", "API_KEY", "password", "TOKEN", "access_key", "auth_token", "Bearer",
               "credential")
    join = pick(5, ' = "', "=", ': "', ": ", " ", '="', " = ", ' => "')
    good = F.struct(secret.alias("value"), F.concat(pick(6, "set the ", "", "config ", "erin ", "\n"), key, join).alias("left"),
                    pick(7, '" then', '"', " and", '";\n', "", '"### the', '" |').alias("right"), F.lit(1).alias("label"))
    word = pick(8, "example", "message", "version", "sample", "password", "homepage", "service")
    plain = pick(9, F.rpad(digits, 16, "7"), F.substring(hexes, 1, 40), F.substring(hexes, 1, 64),
                 F.concat_ws("-", F.substring(hexes, 1, 8), F.substring(hexes, 9, 4), F.substring(hexes, 13, 4),
                             F.substring(hexes, 17, 12)),
                 F.concat(word, F.lit("_"), pick(10, "test_file", "user_name", "main_index"), F.lit("_2024")),
                 F.concat(F.lit("img/"), word, F.lit("/2023/"), cut(hexes, 11, 8, 12)),
                 F.rpad(digits, 16, "3"), F.concat(F.lit("xxxxxxxxxxxxxxxx"), F.lit("0")))
    before = pick(12, "sha256: ", "commit ", "card ", "of the ", "over ", "https://host.example/", "see ", "/var/lib/",
                  "order no ", "in hent ", "checksum=", "that, ", " | ", "uuid: ")
    bad = F.struct(plain.alias("value"), before.alias("left"),
                   pick(13, " and", ".", "/x.png", " the", "\n", ", on", "") .alias("right"), F.lit(0).alias("label"))
    return spark.range(rows).select(F.when(F.col("id") % 2 == 0, good).otherwise(bad).alias("f")).select("f.*")


def train_forest(findings: DataFrame, trees: int = TREES, depth: int = DEPTH) -> list[tuple]:
    """Trees as nested tuples (feature, threshold, left, right) with leaves of P(secret)."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    made = features(F.col("value"), F.col("left"), F.col("right"))
    rows = findings.filter("value is not null and label in (0, 1)").na.fill("", ["left", "right"])
    rows = rows.select(*[c.alias(n) for n, c in made.items()], F.col("label").cast("double").alias("label"))
    rows = VectorAssembler(inputCols=list(made), outputCol="features").transform(rows).select("features", "label")
    model = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=5, subsamplingRate=0.8).fit(rows)
    names = list(made)

    def walk(node) -> tuple | float:
        if node.getClass().getSimpleName() == "LeafNode":
            p = list(node.impurityStats().stats())
            return p[1] / (p[0] + p[1]) if len(p) > 1 and p[0] + p[1] else float(node.prediction())
        s = node.split()
        return names[s.featureIndex()], s.threshold(), walk(node.leftChild()), walk(node.rightChild())

    return [walk(t._java_obj.rootNode()) for t in model.trees]


def forest_score(trees: list, values: dict[str, Column] | Column) -> Column:
    """Mean of the trees' leaves as a column."""
    def tree(node) -> Column:
        if isinstance(node, float):
            return F.lit(node)
        name, cut, left, right = node
        return F.when(values[name] <= cut, tree(left)).otherwise(tree(right))

    total = tree(trees[0])
    for t in trees[1:]:
        total = total + tree(t)
    return total / len(trees)


def found_candidates(docs: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add the candidates of whole texts: array of struct (value, left, right, start), start from 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    held = pin(docs, "_values", F.regexp_extract_all(text, F.lit(f"({CANDIDATE})"), F.lit(1)))
    # the pieces between candidates; only texts that have any are cut
    pieces = F.when(F.size("_values") > 0, F.split(text, CANDIDATE, -1)).otherwise(F.array().cast("array<string>"))
    held = pin(held, "_pieces", pieces)
    ahead = F.aggregate(
        F.arrays_zip(F.col("_values").alias("v"), F.col("_pieces").alias("p")), F.array(F.lit(0)).cast("array<int>"),
        lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + F.length(x["p"]) + F.coalesce(F.length(x["v"]), F.lit(0)))))
    n = F.size("_values")
    held = pin(held, "_ahead", F.when(n > 0, ahead).otherwise(F.array().cast("array<int>")))
    parts = F.arrays_zip(
        F.col("_values").alias("value"), F.slice("_pieces", 1, n).alias("before"), F.slice("_pieces", 2, n).alias("after"),
        F.slice("_ahead", 1, n).alias("ahead"))
    rows = F.transform(parts, lambda x: F.struct(
        x["value"].alias("value"), F.right(x["before"], F.lit(AROUND)).alias("left"),
        F.left(x["after"], F.lit(AROUND)).alias("right"), (x["ahead"] + F.length(x["before"])).alias("start")))
    return pin(held, out, F.when(n > 0, rows).otherwise(F.array().cast(
        "array<struct<value:string,left:string,right:string,start:int>>"))).drop("_values", "_pieces", "_ahead")


def scan_secrets(docs: DataFrame, trees: list, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row of ``docs`` with ``_secrets``, an array of struct (value, start, score), ``_candidates``, the count of all
    strings judged, and ``_peak``, the highest score among them.

    Map-only. Null and empty texts have none; a secret that repeats within a text is found at each
    place; repeated rows and other columns stay as they are.
    """
    held = found_candidates(docs, text_col, "_found")
    # features first, then the trees read them, so that no feature is computed once a split
    described = F.transform("_found", lambda x: F.struct(
        x["value"].alias("value"), x["start"].alias("start"),
        F.struct(*[c.alias(n) for n, c in features(x["value"], x["left"], x["right"]).items()]).alias("f")))
    held = pin(held, "_described", described)
    judged = F.transform("_described", lambda x: F.struct(
        x["value"].alias("value"), x["start"].alias("start"), forest_score(trees, x["f"]).alias("score")))
    held = pin(held, "_judged", judged)
    return held.select(*docs.columns, F.size("_found").alias("_candidates"), F.array_max("_judged.score").alias("_peak"),
                       F.filter("_judged", lambda x: x["score"] >= threshold).alias("_secrets"))


def secret_report(docs: DataFrame, trees: list, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, starts, secrets, max_score) for each row."""
    s = scan_secrets(docs.select("doc_id", "text"), trees, "text", threshold)
    return s.select("doc_id", F.col("_candidates").cast("long").alias("n_candidates"),
                    F.size("_secrets").cast("long").alias("n_secrets"), F.col("_secrets.start").alias("starts"),
                    F.col("_secrets.value").alias("secrets"), F.col("_peak").alias("max_score"))


def redact_secrets(docs: DataFrame, trees: list, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Same rows and columns; each secret in the text gives way to a mark."""
    s = scan_secrets(docs, trees, text_col, threshold)
    clean = F.aggregate("_secrets", F.col(text_col), lambda t, x: F.replace(t, x["value"], F.lit(REDACTED)))
    return s.select(*[F.when(F.size("_secrets") > 0, clean).otherwise(F.col(c)).alias(c) if c == text_col else c
                      for c in docs.columns])
