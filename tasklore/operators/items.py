"""Items: tags, similarity, co-occurrence graph and its communities, vectors, clusters, and sequences for a sequence model."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, CountVectorizer, Word2Vec
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tasklore.operators import skipgram
from tasklore.sources.store import cut

# Tokens that Spark's Word2Vec fits in one part, and words up to which it is used, as it holds them all on the driver.
TOKENS_A_FIT, WORDS_ON_DRIVER = 1_000_000, 10_000


def tag_features(items: DataFrame, tags: str = "tags") -> DataFrame:
    """Adds question_tags (place of the whole tag string among all, in string order) and question_tag (its first tag)."""
    filled = items.withColumn(tags, F.coalesce(tags, F.lit("0")))
    codes = filled.select(tags).distinct()
    codes = codes.withColumn("question_tags", F.row_number().over(Window.orderBy(tags)) - 1)  # distinct strings only
    return filled.join(codes, tags).withColumn("question_tag", F.split(tags, " ")[0])


def jaccard(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))


def tag_similarity(tag_strings: DataFrame, tags: str = "tags") -> DataFrame:
    """a, b, similarity for all pairs of distinct tag strings that share a tag; all others have 0.

    Pairs meet on their tags, so strings without a common one are never paired.
    """
    sets = tag_strings.select(tags).distinct().withColumn("s", F.array_distinct(F.split(tags, " ")))
    words = sets.select(F.col(tags).alias("t"), "s", F.explode("s").alias("w"))
    x, y = words.alias("x"), words.alias("y")
    pairs = x.join(y, F.col("x.w") == F.col("y.w")).select(F.col("x.t").alias("a"), F.col("y.t").alias("b"), F.col("x.s").alias("p"), F.col("y.s").alias("q"))
    return pairs.distinct().select("a", "b", jaccard(F.col("p"), F.col("q")).alias("similarity"))


def tag_graph(items: DataFrame, item: str = "content_id", tags: str = "tags") -> DataFrame:
    """src, dst, w: how many tags two different items share, for ordered pairs."""
    words = items.select(item, F.explode(F.array_distinct(F.split(tags, " "))).alias("w"))
    a, b = words.alias("a"), words.alias("b")
    pairs = a.join(b, (F.col("a.w") == F.col("b.w")) & (F.col(f"a.{item}") != F.col(f"b.{item}")))
    return pairs.groupBy(F.col(f"a.{item}").alias("src"), F.col(f"b.{item}").alias("dst")).agg(F.count("*").alias("w"))


def tag_class_graph(items: DataFrame, tags: str = "tags") -> DataFrame:
    """src, dst, w, src_items, dst_items: how many tags the items of one tag string share with those of another, or with each
    other (src = dst). Items of one tag string are alike to the graph, so its edges join classes, however many items they hold.
    """
    classes = items.groupBy(tags).agg(F.count("*").alias("n"))
    words = classes.select(F.col(tags).alias("t"), "n", F.explode(F.array_distinct(F.split(tags, " "))).alias("w"))
    a, b = words.alias("a"), words.alias("b")
    pairs = a.join(b, (F.col("a.w") == F.col("b.w")) & ((F.col("a.t") != F.col("b.t")) | (F.col("a.n") > 1)))
    return pairs.groupBy(F.col("a.t").alias("src"), F.col("b.t").alias("dst")).agg(
        F.count("*").alias("w"), F.first("a.n").alias("src_items"), F.first("b.n").alias("dst_items")
    )


def item_communities(items: DataFrame, item: str, tags: str) -> DataFrame:
    """item, community: communities of the graph whose edges join all items that share a tag. Items of one tag string are
    alike to it, so it is solved over their classes, each edge with the weight of all pairs of items that it stands for."""
    pairs = F.col("src_items") * F.when(F.col("src") == F.col("dst"), F.col("dst_items") - 1).otherwise(F.col("dst_items"))
    found = communities(tag_class_graph(items, tags).select("src", "dst", (F.col("w") * pairs).alias("w")))
    return items.select(item, tags).join(found, F.col(tags) == F.col("node"), "left").select(item, F.coalesce("community", tags).alias("community"))


def communities(edges: DataFrame, rounds: int = 100, levels: int = 20) -> DataFrame:
    """node, community: level by level, nodes move to the community with the largest gain in modularity until none moves, and
    the communities become the nodes of the next level, whose edges are the sums of those between them; until a level moves
    nothing. Then single nodes may move again from where they are, and levels follow, as long as modularity rises. Raises if
    the rounds or levels do not suffice.

    edges: src, dst, w with both directions of each; an edge of a node with itself counts once. A community is named by one of
    its nodes. Every level is joins and aggregates over its edges, and each is smaller than the one before.
    """
    own = cut(edges.select("src", "dst", "w"))
    best = _levels(own, None, rounds, levels)
    value = modularity(own, best).first()[0]
    while value is not None:
        again = _levels(own, best, rounds, levels)
        now = modularity(own, again).first()[0]
        if now <= value + 1e-9:
            break
        best, value = again, now
    return best


def _levels(edges: DataFrame, start: DataFrame | None, rounds: int, levels: int) -> DataFrame:
    """The levels of communities, from single nodes or from the labels given (node, community)."""
    labels, now = None, edges
    for level in range(levels):
        found, moved = _settled(now, rounds, start if level == 0 else None)
        labels = found if labels is None else cut(labels.join(found.select(F.col("node").alias("community"), F.col("community").alias("_up")), "community").select("node", F.col("_up").alias("community")))
        if not moved and (level or start is None):
            return labels
        a, b = (found.select(F.col("node").alias(c), F.col("community").alias(f"_{c}")) for c in ("src", "dst"))
        now = cut(now.join(a, "src").join(b, "dst").groupBy(F.col("_src").alias("src"), F.col("_dst").alias("dst")).agg(F.sum("w").alias("w")))
    raise RuntimeError(f"communities did not settle in {levels} levels")


def _settled(edges: DataFrame, rounds: int, start: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """node, community of one level, and whether any node moved from the labels it started with.

    A round moves a share of the nodes (by a hash of round and node), so that two neighbours do not swap for ever; the share
    halves every twenty rounds. Labels start as the nodes themselves if none are given; ties go to the node's own, else to the smallest. A level
    has settled when in a round no node at all, of its share or not, would gain by moving.
    """
    degree = edges.groupBy(F.col("src").alias("node")).agg(F.sum("w").alias("d"))
    total = edges.agg(F.sum("w").alias("m"))  # one row
    labels, moved = degree.select("node", F.col("node").alias("c")) if start is None else start.select("node", F.col("community").alias("c")), False
    for k in range(rounds):
        weight = degree.join(labels, "node").groupBy("c").agg(F.sum("d").alias("dc"))
        # an edge of a node with itself moves with it, and so counts for no label
        to = edges.where("src <> dst").join(labels, edges["dst"] == labels["node"]).groupBy(F.col("src").alias("node"), "c").agg(F.sum("w").alias("k"))
        own = labels.select("node", F.col("c").alias("now"))
        # a node's own label is a choice even where no neighbour has it
        choices = to.unionByName(own.select("node", F.col("now").alias("c"), F.lit(0).cast(dict(to.dtypes)["k"]).alias("k"))).groupBy("node", "c").agg(F.sum("k").alias("k"))
        scored = choices.join(degree, "node").join(own, "node").join(weight, "c").crossJoin(F.broadcast(total))
        others = F.col("dc") - F.when(F.col("c") == F.col("now"), F.col("d")).otherwise(0)
        if dict(to.dtypes)["k"] == "bigint":  # m times the gain, a whole number: products of two sums pass a long
            k_m, d_o = (a.cast("decimal(19,0)") * b.cast("decimal(19,0)") for a, b in ((F.col("k"), F.col("m")), (F.col("d"), others)))
            scored = scored.withColumn("gain", k_m - d_o)
        else:
            scored = scored.withColumn("gain", F.round(F.col("k") - F.col("d") * others / F.col("m"), 9))
        best = scored.groupBy("node").agg(F.min(F.struct(-F.col("gain"), F.when(F.col("c") == F.col("now"), 0).otherwise(1), "c"))["c"].alias("best"))
        moves = F.pmod(F.xxhash64(F.lit(k), F.col("node")), F.lit(4 << k // 20)) == 0
        after = labels.join(best, "node").select("node", F.when(moves, F.col("best")).otherwise(F.col("c")).alias("c"), (F.col("best") != F.col("c")).alias("would"))
        after = cut(after)
        labels = after.select("node", "c")
        if not after.where("would").limit(1).count():
            return labels.select("node", F.col("c").alias("community")), moved
        moved = True
    raise RuntimeError(f"communities did not settle in {rounds} rounds")


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """One row, modularity: the share of weight inside communities, less what is expected from their nodes' degrees."""
    a, b = (labels.select(F.col("node").alias(c), F.col("community").alias(f"_{c}")) for c in ("src", "dst"))
    own = edges.join(a, "src").join(b, "dst")
    inside = own.groupBy("_src").agg(F.sum("w").alias("d"), F.sum(F.when(F.col("_src") == F.col("_dst"), F.col("w")).otherwise(0)).alias("i"))
    total = inside.agg(F.sum("d").alias("m"))  # one row
    return inside.crossJoin(F.broadcast(total)).agg(F.sum(F.col("i") / F.col("m") - F.pow(F.col("d") / F.col("m"), 2)).alias("modularity"))


def sentences(log: DataFrame, token: Column, key: str = "user_id") -> DataFrame:
    """key, tokens: a user's tokens in order."""
    rows = log.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("rn", token.cast("string").alias("t")))).alias("l"))
    return rows.select(key, F.col("l.t").alias("tokens"))


def item_vectors(log: DataFrame, token: Column, size: int = 16, window: int = 5, seed: int = 42, iterations: int = 1) -> DataFrame:
    """word, vector: skip-gram vectors of the tokens of users' histories."""
    told = cut(sentences(log, token))
    if _many(told):
        return skipgram.fit(told, 0, size, window, seed, iterations)
    return _vectors(told, size, window, seed, iterations)


def _many(told: DataFrame) -> bool:
    return told.select(F.explode("tokens").alias("t")).agg(F.approx_count_distinct("t")).first()[0] > WORDS_ON_DRIVER


def _vectors(told: DataFrame, size: int, window: int, seed: int, iterations: int) -> DataFrame:
    """item_vectors of written histories, written, so that the driver holds one model at a time. Each TOKENS_A_FIT tokens are
    fitted apart, as far as there are cores, and Spark averages the fits."""
    n = told.agg(F.coalesce(F.sum(F.size("tokens")), F.lit(0))).first()[0]
    parts = max(1, min(told.sparkSession.sparkContext.defaultParallelism, n // TOKENS_A_FIT))
    model = Word2Vec(vectorSize=size, windowSize=window, minCount=1, seed=seed, maxIter=iterations, numPartitions=parts, inputCol="tokens", outputCol="v").fit(told)
    return cut(model.getVectors().select("word", vector_to_array("vector").alias("vector")))


def answer_vectors(log: DataFrame, n_folds: int = 5, size: int = 16, window: int = 5, seed: int = 42, iterations: int = 1) -> DataFrame:
    """fold, content_id, correct, vector: skip-gram vectors of items answered right (1) and wrong (0), for each fold of users
    trained on the histories of all the others. Few words take one fit for each fold; many are fitted for all folds at once."""
    token = F.concat(F.when(F.col("answered_correctly") == 1, "").otherwise("-"), F.col("content_id").cast("string"))
    told = cut(sentences(log, token).withColumn("fold", F.pmod(F.col("user_id"), F.lit(n_folds)).cast("int")))
    out = skipgram.fit(told, n_folds, size, window, seed, iterations) if _many(told) else None
    for k in range(n_folds) if out is None else ():
        rows = told.where(F.col("fold") != k)
        if rows.limit(1).count():
            own = _vectors(rows, size, window, seed, iterations).withColumn("fold", F.lit(k))
            out = own if out is None else out.unionByName(own)
    if out is None:
        raise ValueError("no fold has other users to learn from")
    wrong = F.col("word").startswith("-")
    return out.select("fold", F.abs(F.col("word").cast("long")).alias("content_id"), F.when(wrong, 0).otherwise(1).alias("correct"), "vector")


def clusters(vectors: DataFrame, k: int, column: str = "vector", seeds: tuple[int, ...] = (123,)) -> DataFrame:
    """Adds category: the k-means cluster, of the seed with the least cost."""
    data = vectors.withColumn("features", array_to_vector(F.col(column).cast("array<double>")))
    models = [KMeans(k=k, seed=s, featuresCol="features", predictionCol="category").fit(data) for s in seeds]
    return min(models, key=lambda m: m.summary.trainingCost).transform(data).drop("features")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def tag_covariance(items: DataFrame, item: str, tags: str) -> DataFrame:
    """a, b, covariance of the 0/1 columns that say which tags an item has, for tags that some item has both of, in either
    order and with themselves. Any other pair has -p_a p_b n / (n - 1), p being a tag's share of the n items.

    Pairs are made inside a row, from its own tags; a null tag string has no tags.
    """
    own = items.select(item, F.array_distinct(F.filter(F.split(F.coalesce(tags, F.lit("")), " "), lambda x: x != "")).alias("s"))
    total = own.agg(F.count("*").alias("n"))  # one row
    ones = own.select(F.explode("s").alias("t")).groupBy("t").agg(F.count("*").alias("c"))
    both = own.select(F.explode("s").alias("a"), "s").select("a", F.explode("s").alias("b")).groupBy("a", "b").agg(F.count("*").alias("ab"))
    rows = both.join(ones.select(F.col("t").alias("a"), F.col("c").alias("ca")), "a").join(ones.select(F.col("t").alias("b"), F.col("c").alias("cb")), "b").crossJoin(F.broadcast(total))
    return rows.select("a", "b", F.try_divide(F.col("ab") - F.col("ca") * F.col("cb") / F.col("n"), F.col("n") - 1).alias("covariance"))


def tag_components(items: DataFrame, item: str, tags: str, k: int) -> tuple[DataFrame, list[float]]:
    """(item, components), and the share of variance that each of the k explains: principal components of the 0/1 columns of
    tags. Spark adds up the covariance over the cluster; its eigenvectors are taken on the driver, a number for each pair of
    tags (tags are a few hundred; beyond 65,535 Spark refuses)."""
    own = items.select(item, F.filter(F.split(F.coalesce(tags, F.lit("")), " "), lambda x: x != "").alias("_s"))
    counted = CountVectorizer(binary=True, minDF=1, inputCol="_s", outputCol="_hot").fit(own).transform(own)
    model = PCA(k=k, inputCol="_hot", outputCol="_pca").fit(counted)
    return model.transform(counted).select(item, vector_to_array("_pca").alias("components")), model.explainedVariance.tolist()


def usual_category(items: DataFrame, group: str, category: str) -> DataFrame:
    """Adds category where it is null: the most frequent one of the item's group (the smallest, in a tie)."""
    counts = items.where(F.col(category).isNotNull()).groupBy(group, category).agg(F.count("*").alias("n"))
    order = Window.partitionBy(group).orderBy(F.col("n").desc(), category)
    top = counts.withColumn("r", F.row_number().over(order)).where("r = 1").select(group, F.col(category).alias("_usual"))
    return items.join(top, group, "left").withColumn(category, F.coalesce(category, "_usual")).drop("_usual")


def padded_chunks(log: DataFrame, value: Column, length: int = 100) -> DataFrame:
    """user_id, chunk, seq: a user's values in order, in chunks of `length`, the first padded with zeros on the left."""
    n = F.count("*").over(Window.partitionBy("user_id"))
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("rn")) - 1 + F.pmod(-n, F.lit(length))
    rows = log.select("user_id", place.alias("p"), value.alias("v")).withColumn("chunk", F.floor(F.col("p") / length))
    lists = rows.groupBy("user_id", "chunk").agg(F.array_sort(F.collect_list(F.struct("p", "v"))).alias("l"))
    own = F.col("l.v")
    pad = F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size(own))
    return lists.select("user_id", "chunk", F.concat(pad, F.transform(own, lambda x: x.cast("long"))).alias("seq"))


def shifted(chunks: DataFrame) -> DataFrame:
    """encoder and decoder inputs and the label of a sequence: all but the first, all but the last, all but the first."""
    n = F.size("seq") - 1
    tail, head = F.slice("seq", F.lit(2), n), F.slice("seq", F.lit(1), n)
    return chunks.select("user_id", "chunk", tail.alias("encoder"), head.alias("decoder"), tail.alias("label"))


def log_time_scores(df: DataFrame, column: str) -> DataFrame:
    """Adds column_z: the z-score of ln(1 + milliseconds / 1000); 0 for null."""
    seconds = F.ln(F.col(column) / 1000 + 1)
    facts = df.agg(F.avg(seconds).alias("_m"), F.stddev_pop(seconds).alias("_d"))  # one row
    out = df.crossJoin(F.broadcast(facts))
    return out.withColumn(f"{column}_z", F.coalesce(F.try_divide(seconds - F.col("_m"), F.col("_d")), F.lit(0.0))).drop("_m", "_d")
