"""Models with closed forms or driver loops of aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.operators.neighbors import with_cluster
from tessel.operators.stats import unpivot


def gaussian_nb(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """(class, feature, prior, mean, var): population variance plus 1e-9 of the largest."""
    g = unpivot(df, features, keep=[target]).groupBy(F.col(target).alias("class"), "feature").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.var_pop("value").alias("var"))
    total = F.sum("n").over(Window.partitionBy("feature"))
    return g.select("class", "feature", (F.col("n") / total).alias("prior"), "mean", (F.col("var") + 1e-9 * F.max("var").over(Window.partitionBy())).alias("var"))


def gaussian_predict(df: DataFrame, key: str, features: list[str], model: DataFrame) -> DataFrame:
    """(key, class) with the largest log-likelihood; of equals the lowest class."""
    j = unpivot(df, features, keep=[key]).join(F.broadcast(model), "feature")
    d = F.col("value") - F.col("mean")
    ll = -0.5 * F.log(2 * 3.141592653589793 * F.col("var")) - d * d / (2 * F.col("var"))
    s = j.groupBy(key, "class", "prior").agg(F.sum(ll).alias("ll")).withColumn("ll", F.col("ll") + F.log("prior"))
    return s.groupBy(key).agg(F.min_by("class", F.struct(-F.col("ll"), F.col("class"))).alias("class"))


def multinomial_nb(counts: DataFrame, labels: DataFrame, key: str, target: str, alpha: float = 1.0) -> DataFrame:
    """(class, term, log_prob) from term counts: ln((n + a) / (total + a * terms))."""
    own = counts.join(labels.select(key, F.col(target).alias("class")), key)
    terms = own.select("term").distinct()
    grid = terms.crossJoin(F.broadcast(own.select("class").distinct()))
    g = grid.join(own.groupBy("class", "term").agg(F.sum("n").alias("n")), ["class", "term"], "left").select("class", "term", F.coalesce("n", F.lit(0)).alias("n"))
    every = Window.partitionBy("class")
    return g.select("class", "term", F.log((F.col("n") + alpha) / (F.sum("n").over(every) + alpha * F.count("*").over(every))).alias("log_prob"))


def bernoulli_nb(df: DataFrame, features: list[str], target: str, threshold: float = 0.0, alpha: float = 1.0) -> DataFrame:
    """(class, feature, p): (rows above the threshold + a) / (rows + 2a)."""
    g = unpivot(df, features, keep=[target]).groupBy(F.col(target).alias("class"), "feature")
    return g.agg(((F.sum((F.col("value") > threshold).cast("double")) + alpha) / (F.count("*") + 2 * alpha)).alias("p"))


def least_squares(df: DataFrame, features: list[str], target: str, alpha: float = 0.0) -> DataFrame:
    """(term, coef) of ordinary or ridge regression; the intercept carries no penalty. One aggregate of products, about
    the means of the columns for accuracy, then a small solve on the driver."""
    import numpy as np

    columns = [*features, target]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    r = df.agg(F.count("*").alias("n"), *(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs))).first()
    k, at = len(features), {p: i for i, p in enumerate(pairs)}
    c = np.array([[r[f"c{at.get((a, b), at.get((b, a)))}"] for b in columns] for a in columns]) * r["n"]
    beta = np.linalg.lstsq(c[:k, :k] + alpha * np.eye(k), c[:k, k], rcond=None)[0]
    rows = [("intercept", float(r[f"m{k}"] - sum(b * r[f"m{i}"] for i, b in enumerate(beta)))), *((f, float(b)) for f, b in zip(features, beta, strict=True))]
    return df.sparkSession.createDataFrame(rows, "term string, coef double")


def coordinate_descent(df: DataFrame, features: list[str], target: str, alpha: float = 1.0, l1_ratio: float = 1.0, tol: float = 1e-4, rounds: int = 1000) -> DataFrame:
    """(term, coef) of lasso or elastic net: squared error / 2n + alpha * (r |w| + (1 - r) w**2 / 2), on the Gram matrix."""
    import numpy as np

    columns = [*features, target]
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    r = df.agg(*(F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)), *(F.covar_pop(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs))).first()
    at, k = {p: i for i, p in enumerate(pairs)}, len(features)
    g = np.array([[r[f"c{at.get((a, b), at.get((b, a)))}"] for b in columns] for a in columns])
    w = np.zeros(k)
    for _ in range(rounds):
        moved = 0.0
        for j in range(k):
            rho = g[j, k] - g[j, :k] @ w + g[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - alpha * l1_ratio, 0) / max(g[j, j] + alpha * (1 - l1_ratio), 1e-12)
            moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < tol:
            break
    rows = [("intercept", float(r[f"m{k}"] - sum(b * r[f"m{i}"] for i, b in enumerate(w)))), *((f, float(b)) for f, b in zip(features, w, strict=True))]
    return df.sparkSession.createDataFrame(rows, "term string, coef double")


def logistic(df: DataFrame, features: list[str], target: str, c: float = 1.0, rounds: int = 25) -> DataFrame:
    """(term, coef) of binary logistic regression, mean log-loss + w**2 / (2 C n), by Newton steps: one aggregate each."""
    import numpy as np

    x = [F.lit(1.0), *(F.col(f).cast("double") for f in features)]
    k, w = len(x), np.zeros(len(x))
    d = df.select(*(e.alias(f"x{i}") for i, e in enumerate(x)), F.col(target).cast("double").alias("y"))
    for _ in range(rounds):
        z: Column = sum((F.col(f"x{i}") * float(w[i]) for i in range(1, k)), F.lit(float(w[0])))
        p = 1 / (1 + F.exp(-z))
        t = d.withColumns({"p": p}).withColumns({"e": F.col("p") - F.col("y"), "h": F.col("p") * (1 - F.col("p"))})
        r = t.agg(F.count("*").alias("n"), *(F.avg(F.col("e") * F.col(f"x{i}")).alias(f"g{i}") for i in range(k)), *(F.avg(F.col("h") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}_{j}") for i in range(k) for j in range(i, k))).first()
        ridge = np.array([0.0] + [1 / (c * r["n"])] * (k - 1))
        g = np.array([r[f"g{i}"] for i in range(k)]) + ridge * w
        h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + np.diag(ridge + 1e-12)
        step = np.linalg.solve(h, g)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return df.sparkSession.createDataFrame([(t, float(v)) for t, v in zip(["intercept", *features], w, strict=True)], "term string, coef double")


def lloyd(df: DataFrame, key: str, vec: str, centroids: DataFrame) -> DataFrame:
    """(cluster, center, n) after one step."""
    a = with_cluster(df.select(F.col(vec).alias("_v")), "_v", centroids).where("_near IS NOT NULL")
    long = a.select(F.col("_near.cluster").alias("cluster"), F.posexplode("_v").alias("i", "v")).groupBy("cluster", "i").agg(F.avg(F.col("v").cast("double")).alias("m"), F.count("*").alias("n"))
    return long.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("center"), F.max("n").alias("n"))


def kmeans(df: DataFrame, key: str, vec: str, k: int, rounds: int = 20, tol: float = 1e-4) -> DataFrame:
    """(cluster, center, n) by Lloyd's steps from centres drawn by a hash, farthest first among 8k candidates."""
    import numpy as np

    spark = df.sparkSession
    rows = df.select(F.col(vec).cast("array<double>").alias("v")).orderBy(F.xxhash64(key)).limit(8 * k).collect()
    x = np.array([r["v"] for r in rows])
    chosen = [0]
    while len(chosen) < min(k, len(x)):
        d = ((x[:, None] - x[chosen][None]) ** 2).sum(2).min(1)
        chosen.append(int(d.argmax()))
    now = [(i, x[c].tolist()) for i, c in enumerate(chosen)]
    out = None
    for _ in range(rounds):
        out = lloyd(df, key, vec, spark.createDataFrame(now, "cluster int, center array<double>")).collect()
        after = dict(now) | {r["cluster"]: list(r["center"]) for r in out}
        shift = max(float(((np.array(after[i]) - np.array(c)) ** 2).sum()) for i, c in now)
        now = sorted(after.items())
        if shift < tol:
            break
    return spark.createDataFrame([(r["cluster"], list(r["center"]), r["n"]) for r in out or []], "cluster int, center array<double>, n long")


def forest(df: DataFrame, features: list[str], target: str, trees: int = 20, depth: int = 8, seed: int = 1):
    """A fitted random forest of Spark ML over an assembled vector; transform() gives its prediction."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="_features"), RandomForestClassifier(featuresCol="_features", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed)]).fit(df)


def vote(predictions: DataFrame, key: str, label: str, weight: str | None = None) -> DataFrame:
    """(key, label) with most votes; of equals the highest label."""
    v = predictions.groupBy(key, label).agg((F.sum(weight) if weight else F.count("*")).alias("_v"))
    return v.groupBy(key).agg(F.max_by(label, F.struct("_v", label)).alias(label))
