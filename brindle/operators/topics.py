"""Topics of records: sizes, roll-ups, keywords, labels, representatives, catalog; a pluggable clusterer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from brindle.functions.scalars import SPACE, snippet, topic_label
from brindle.sources.tables import cut

OUTLIERS = -1
KEYWORDS = 15
LISTED_STOPWORDS = 100_000
# Fixed value: conversational fillers and role names that carry no topic.
FILLER_WORDS = """prospect user unknown external internal yeah okay ok uh um umm hmm mm ah oh yep nope like know just really
actually basically kind sort going got gonna wanna kinda stuff thing things right sure maybe mean guess think say said saying
guys alright perfect cool exactly bit good new ve ll don doesn didn isn wasn want click clicks ahead scroll test
different quite suppose probably little looks today way""".split()


def top_n(df: DataFrame, key: str, n: int, order: list[Column], rank: str = "rank") -> DataFrame:
    """The first n rows of each key. Spark prunes each map task to n rows per key before the shuffle (``WindowGroupLimit``)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col(rank) <= n)


def assignments(record_topics: DataFrame) -> DataFrame:
    """``(record_id, topic_id, probability)``: the latest assignment of each tidied record id."""
    from brindle.operators.orphans import tidy_id

    rows = record_topics.select(tidy_id(F.col("record_id")).alias("record_id"), F.struct("loaded_at", "topic_id", "probability").alias("a"))
    return rows.where("record_id IS NOT NULL").groupBy("record_id").agg(F.max("a").alias("a")).select("record_id", "a.topic_id", "a.probability")


def topic_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("topic_id").agg(F.count("*").alias("size"))


def parent_topics(assigned: DataFrame, records: DataFrame) -> DataFrame:
    """Primary topic of each parent, its share, up to three secondary ones, and its chunks; ties by topic id."""
    counts = assigned.join(records.select(F.col("id").alias("record_id"), "parent_id"), "record_id").groupBy("parent_id", "topic_id").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("parent_id"))
    first = top_n(counts.withColumn("total", total), "parent_id", 4, [F.desc("n"), F.col("topic_id")])
    shared = first.withColumn("share", F.round(F.col("n") / F.col("total"), 4))
    ordered = F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "topic_id", "n", "share"))))
    return shared.groupBy("parent_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("topic_id"))).alias("primary_topic_id"),
        F.max(F.when(F.col("rank") == 1, F.col("share"))).alias("primary_share"),
        F.max("total").alias("chunk_count"),
        F.transform(ordered, lambda x: F.concat_ws(":", x["topic_id"].cast("string"), x["n"].cast("string"))).alias("secondary"),
        F.transform(ordered, lambda x: x["share"]).alias("secondary_shares"),
    )


def speaker_words(names: DataFrame) -> DataFrame:
    """``(word)``: the lower-case words of all names in a column ``name``, letters of any script only, and the runs of plain letters in them."""
    lower = names.where("name IS NOT NULL").select(F.lower("name").alias("name")).distinct()
    words = F.concat(F.transform(F.split("name", rf"{SPACE}+"), lambda w: F.regexp_replace(w, r"[^\p{L}]", "")), F.regexp_extract_all("name", F.lit("([a-z][a-z]+)"), 1))
    return lower.select(F.explode(words).alias("word")).where("length(word) >= 2").distinct()


def class_terms(texts: DataFrame, stopwords: list[str] | DataFrame, bigrams: bool = True) -> DataFrame:
    """``(topic_id, term, tf)`` of one- and two-word terms; pairs form after the stop words are gone.

    Stop words are a list, or a table with a column ``word`` of any size: one of more than ``LISTED_STOPWORDS`` words is
    joined with the words of the texts, with the same result.
    """
    words = F.coalesce(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}_])([a-z]{2,})(?![\p{L}\p{N}_])"), 1), F.array().cast("array<string>"))
    tokens = texts.select("topic_id", words.alias("w"))
    if isinstance(stopwords, DataFrame):
        distinct = cut(stopwords.select("word").where("word IS NOT NULL").distinct())
        many = distinct.count() > LISTED_STOPWORDS
        stopwords = [] if many else [r["word"] for r in distinct.collect()]
        if many:
            each = tokens.withColumn("row", F.monotonically_increasing_id()).select("topic_id", "row", F.posexplode("w").alias("at", "word"))
            kept = each.join(distinct, "word", "left_anti").groupBy("topic_id", "row").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))  # the words of one text
            tokens = kept.select("topic_id", F.transform("w", lambda x: x["word"]).alias("w"))
    if stopwords:
        tokens = tokens.withColumn("w", F.filter("w", lambda w: ~w.isin(stopwords)))
    if bigrams:
        # zip_with pads the shorter side with null, and concat with null is null
        pairs = F.zip_with(F.col("w"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b))
        tokens = tokens.select("topic_id", F.concat("w", F.filter(pairs, lambda p: p.isNotNull())).alias("w"))
    return tokens.select("topic_id", F.explode("w").alias("term")).groupBy("topic_id", "term").agg(F.count("*").alias("tf"))


def class_keywords(texts: DataFrame, stopwords: list[str] | DataFrame, keep: int = KEYWORDS, least: int = 2) -> DataFrame:
    """``(topic_id, rank, term, weight)``: class-based TF-IDF with the square root of the term's share in the class.

    weight = sqrt(tf / tokens of the class) * ln(1 + A / f), A the mean number of tokens per class and f the
    term's number over all classes; terms in fewer than ``least`` classes are dropped.
    """
    terms = cut(class_terms(texts, stopwords))  # one row per topic and term, read four times
    overall = terms.groupBy("term").agg(F.sum("tf").alias("f"), F.count("*").alias("classes")).where(F.col("classes") >= least).drop("classes")
    kept = terms.join(overall, "term")
    totals = kept.groupBy("topic_id").agg(F.sum("tf").alias("total"))
    mean = totals.agg(F.avg("total").alias("a"))
    weight = F.sqrt(F.col("tf") / F.col("total")) * F.log1p(F.col("a") / F.col("f"))
    scored = kept.join(totals, "topic_id").crossJoin(F.broadcast(mean)).select("topic_id", "term", F.round(weight, 8).alias("weight"))  # mean is one row
    return top_n(scored, "topic_id", keep, [F.desc("weight"), F.col("term")]).select("topic_id", "rank", "term", "weight")


def labelled_topics(topics: DataFrame) -> DataFrame:
    """Topics with their keywords as an array and the label these give."""
    keywords = F.coalesce(F.from_json("keywords_json", "array<string>"), F.array().cast("array<string>"))
    return topics.select("topic_id", topic_label(F.col("topic_id"), keywords).alias("label"), F.array_join(keywords, ",").alias("keywords"), "size")


def representatives(topics: DataFrame, assigned: DataFrame, most: int = 3) -> DataFrame:
    """``(topic_id, place, record_id)``: the listed representatives, else the first records of the topic."""
    listed = F.from_json("representative_ids_json", "array<string>")
    good = F.coalesce(F.array_distinct(F.filter(listed, lambda x: x.isNotNull())), F.array().cast("array<string>"))
    rows = topics.select("topic_id", F.slice(good, 1, most).alias("ids"))
    own = rows.where(F.size("ids") > 0).select("topic_id", F.posexplode("ids").alias("place", "record_id"))
    others = rows.where(F.size("ids") == 0).select("topic_id")
    first = top_n(assigned.join(others, "topic_id", "left_semi"), "topic_id", most, [F.col("record_id")])
    return own.withColumn("place", F.col("place") + 1).unionByName(first.select("topic_id", F.col("rank").alias("place"), "record_id"))


def top_parents(parents: DataFrame, records: DataFrame, n: int = 10) -> DataFrame:
    """``(topic_id, rank, parent_id, chunk_count, title)``: the largest parents of each primary topic with their first record's title."""
    best = top_n(parents.select(F.col("primary_topic_id").alias("topic_id"), "parent_id", "chunk_count"), "topic_id", n, [F.desc("chunk_count"), F.col("parent_id")])
    titles = records.groupBy("parent_id").agg(F.min(F.struct("id", "title")).alias("f")).select("parent_id", "f.title")
    return best.join(titles, "parent_id", "left").select("topic_id", "rank", "parent_id", "chunk_count", "title")


def hash_sample(df: DataFrame, key: str, id_column: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each key, the same in every run: the first by a hash of their id."""
    return top_n(df, key, n, [F.md5(F.concat_ws(":", F.col(id_column).cast("string"), F.lit(str(seed)))), F.col(id_column)])


def catalog_lines(topics: DataFrame, reps: DataFrame, records: DataFrame, best: DataFrame) -> DataFrame:
    """``(topic_id, order, part, place, line)`` of a readable Markdown catalog of all topics, largest first."""
    named = topics.select("topic_id", "label", "size", F.coalesce(F.from_json("keywords_json", "array<string>"), F.array().cast("array<string>")).alias("k"))
    order = F.struct((-F.coalesce("size", F.lit(0))).alias("s"), F.col("topic_id").alias("t"))
    text = records.groupBy(F.col("id").alias("record_id")).agg(F.min("text").alias("text"))
    heads = named.select(
        order.alias("o"), F.lit(1).alias("part"), F.lit(0).alias("n"),
        F.concat(F.lit("### Topic "), F.col("topic_id").cast("string"), F.lit(": "), F.coalesce("label", F.lit("")), F.lit("\n- **Size**: "), F.coalesce("size", F.lit(0)).cast("string"),
                 F.lit("\n- **Keywords**: "), F.array_join(F.slice("k", 1, KEYWORDS), ", ")).alias("line"),
    )
    excerpts = reps.join(text, "record_id").join(named.select("topic_id", order.alias("o")), "topic_id")
    quotes = excerpts.select("o", F.lit(2).alias("part"), F.col("place").alias("n"), F.concat(F.lit("- `"), F.col("record_id"), F.lit("` - "), snippet(F.col("text"))).alias("line"))
    calls = best.join(named.select("topic_id", order.alias("o")), "topic_id").select(
        "o", F.lit(3).alias("part"), F.col("rank").alias("n"), F.concat(F.lit("- "), F.col("parent_id"), F.lit(": "), F.coalesce("title", F.lit("")), F.lit(" ("), F.col("chunk_count").cast("string"), F.lit(" chunks)")).alias("line")
    )
    return heads.unionByName(quotes).unionByName(calls).orderBy("o", "part", "n").select(F.col("o.t").alias("topic_id"), F.col("o").alias("order"), "part", F.col("n").alias("place"), "line")


def catalog_order() -> WindowSpec:
    """The order of the lines of a catalog: topics from the largest, each with its parts."""
    return Window.orderBy(F.col("order"), F.col("part"), F.col("place"))


def catalog_head(topics: DataFrame) -> DataFrame:
    """``(n, line)``: title, figures, and a table of all topics from the largest, with links to their parts."""
    head = topics.agg(F.count("*").alias("topics"), F.coalesce(F.sum("size"), F.lit(0)).alias("records")).select(
        F.lit(0).alias("n"), F.format_string("# Topics\n\n%d topics, %d records\n\n| Topic | Label | Records |\n|-|-|-|", "topics", F.col("records").cast("bigint")).alias("line")
    )
    rank = F.row_number().over(Window.orderBy(F.coalesce("size", F.lit(0)).desc(), "topic_id"))
    name = F.coalesce("label", F.lit(""))
    anchor = F.regexp_replace(F.regexp_replace(F.lower(F.concat(F.lit("topic "), F.col("topic_id").cast("string"), F.lit(": "), name)), r"[^\p{L}\p{N}_ -]", ""), " ", "-")
    row = F.concat(F.lit("| ["), F.col("topic_id").cast("string"), F.lit("](#"), anchor, F.lit(") | "), F.regexp_replace(name, r"\|", "\\\\|"), F.lit(" | "), F.coalesce("size", F.lit(0)).cast("string"), F.lit(" |"))
    return head.unionByName(topics.select(rank.alias("n"), row.alias("line")))


def cluster(vectors: DataFrame, k: int, least: int = 10, seed: int = 42, dims: int = 5, sample: float | None = None) -> DataFrame:
    """``(id, topic_id, probability)``: PCA and k-means over ``(id, embedding)``; clusters under ``least`` rows are outliers (-1), others numbered by size.

    ``probability`` is 1 / (1 + distance to the centre). With ``sample``, a share of the rows chosen by a hash of their id, the models are fitted
    on those and applied to all. Null embeddings are left out; an empty table gives no row.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = vectors.where("embedding IS NOT NULL").select("id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    if not rows.limit(1).count():
        return vectors.select("id", F.lit(OUTLIERS).alias("topic_id"), F.lit(0.0).alias("probability")).limit(0)
    drawn = rows if sample is None else rows.where(F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), F.lit(1_000_000)) < int(sample * 1_000_000))
    components = PCA(k=dims, inputCol="v", outputCol="features").fit(drawn)
    reduced = components.transform(rows)
    model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="c").fit(components.transform(drawn))
    centres = vectors.sparkSession.createDataFrame([(c, [float(x) for x in v]) for c, v in enumerate(model.clusterCenters())], "c int, centre array<double>")
    placed = model.transform(reduced).select("id", "c", vector_to_array("features").alias("at")).join(F.broadcast(centres), "c")  # k rows
    distance = F.sqrt(F.aggregate(F.zip_with("at", "centre", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x))
    found = placed.select("id", "c", (1 / (1 + distance)).alias("probability"))
    sizes = found.groupBy("c").agg(F.count("*").alias("n"))
    number = F.when(F.col("n") >= least, F.row_number().over(Window.orderBy(F.desc("n"), "c")) - 1).otherwise(OUTLIERS)
    return found.join(F.broadcast(sizes.select("c", number.alias("topic_id"))), "c").select("id", "topic_id", "probability")  # k rows
