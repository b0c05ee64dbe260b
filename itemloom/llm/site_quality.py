"""Quality by hierarchical empirical Bayes: a document's own evidence, its path's posterior, its host's and the global prior."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm import evidence
from itemloom.llm.common import discard, stored

#: Bounds of a level's strength, in documents.
LEAST_STRENGTH, MOST_STRENGTH = 2.0, 10_000.0


def _logit(p):
    return F.log(p / (1 - p))


def _strength(groups: DataFrame, n: str, s: str, center) -> float:
    """How many documents the level above counts for, by the method of moments: how much groups differ beyond chance."""
    m = F.col(s) / F.col(n)
    g = groups.filter(f"{n} > 1").agg(F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(F.col(n) * (m - center) * (m - center)).alias("ss"), F.sum(F.col(n) * center * (1 - center)).alias("v"), F.sum(F.col(n) * F.col(n)).alias("nn")).first()
    if not g["n"] or g["k"] < 2:
        return MOST_STRENGTH
    inside = max(g["v"] / g["n"], 1e-12)
    spread = (g["ss"] - (g["k"] - 1) * inside) / max(g["n"] - g["nn"] / g["n"], 1e-9)
    return min(max(inside / spread - 1, LEAST_STRENGTH), MOST_STRENGTH) if spread > 0 else MOST_STRENGTH


def site_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "quality", threshold: float = 0.5) -> DataFrame:
    """(id, host, path, n_tokens, evidence, host_prior, path_prior, quality, keep) for each row of docs(id, text, host, path).

    The evidence's weights come from labels(id, label). A host's prior is its documents' mean posterior, shrunk towards the
    global one; a path's likewise towards its host's; both without the document itself, whose evidence comes after. Sparse sites so
    stay near the level above. Of a repeated id in labels the largest value counts.
    Null hosts and paths are the site ''; null and empty texts have the evidence of their shape. Sums are rounded to nine
    places. Groups are only summed (partly before the shuffle) and joined, so a host of a third of all rows is no obstacle.
    """
    # other columns, however named, stay behind
    docs = docs.select(F.col(id_col), "text", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
    known = labels.filter(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).alias(label))
    found = evidence.features(docs, [id_col, "host", "path"])
    model = evidence.fit(found, known, [label], id_col)
    prior = model[label]["prior"]
    own = 1 / (1 + F.exp(-(F.col(f"e_{label}") + _logit(F.lit(prior)))))
    rows = stored(evidence.apply(found, model, [id_col, "host", "path", "n_tokens"]).withColumn("q", F.round(own, 9)), "site-evidence")
    discard(found)
    paths = stored(rows.groupBy("host", "path").agg(F.count("*").alias("pn"), F.sum(F.col("q").cast("decimal(20,9)")).cast("double").alias("ps")), "site-paths")
    hosts = paths.groupBy("host").agg(F.sum("pn").alias("hn"), F.sum("ps").alias("hs"))
    total = paths.agg(F.sum("pn"), F.sum("ps")).first()
    mean = min(max((total[1] or 0.0) / max(total[0] or 1, 1), 1e-6), 1 - 1e-6)
    host_strength = _strength(hosts, "hn", "hs", F.lit(mean))
    shrunk = hosts.withColumn("center", (F.lit(host_strength * mean) + F.col("hs")) / (F.lit(host_strength) + F.col("hn")))
    sites = stored(paths.join(shrunk, "host"), "site-priors")
    path_strength = _strength(sites, "pn", "ps", F.col("center"))
    without = lambda c: F.greatest(F.col(c) - F.col("q"), F.lit(0.0))
    host_prior = (F.lit(host_strength * mean) + without("hs")) / (F.lit(host_strength) + F.col("hn") - 1)
    path_prior = (F.lit(path_strength) * host_prior + without("ps")) / (F.lit(path_strength) + F.col("pn") - 1)
    path_prior = F.least(F.greatest(path_prior, F.lit(1e-6)), F.lit(1 - 1e-6))
    out = rows.join(sites, ["host", "path"]).withColumns({"host_prior": host_prior, "path_prior": path_prior})
    quality = 1 / (1 + F.exp(-(F.col(f"e_{label}") + _logit(F.col("path_prior")))))
    out = out.withColumn("quality", F.round(quality, 6)).withColumn("keep", F.col("quality") >= threshold)
    return out.select(id_col, "host", "path", "n_tokens", F.round(f"e_{label}", 6).alias("evidence"), F.round("host_prior", 6).alias("host_prior"), F.round("path_prior", 6).alias("path_prior"), "quality", "keep")
