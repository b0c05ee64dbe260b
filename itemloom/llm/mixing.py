"""Soft-membership mixing: document rates whose expected token totals in each domain match target weights.

Domains are sets of labelled rows, by default the four combinations of the labels quality and toxic; a document belongs to each by
its posterior: one classifier for each domain against the rest, their odds normalised.
The rates x >= 0 minimise, over all documents d with tokens t and posteriors p,
    1/2 sum_k w_k (sum_d x_d t_d p_dk - T_k)^2 / N^2 + ridge/2 sum_d t_d (x_d - 1)^2 / N
by projected gradients with momentum. A gradient needs only the domain totals of the step before, so a step is one pass that
sums a few numbers, and a document's rate is found again from the totals of all steps, of which there are few. The first steps
sum over cells of nearly equal posteriors, which are few; the last ones over all documents with their exact posteriors, until
these don't move any more.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm import evidence
from itemloom.llm.common import discard, stored

#: Each domain's name and its values of the labels' columns.
LABELS = ("quality", "toxic")
DOMAINS = {"clean": (1, 0), "low": (0, 0), "toxic": (1, 1), "low_toxic": (0, 1)}
#: Target shares of the mix's tokens.
TARGETS = {"clean": 0.98, "low": 0.02, "toxic": 0.0, "low_toxic": 0.0}
STEPS, RIDGE, TOLERANCE = 40, 0.002, 1e-4
#: Decimal places of the posteriors of the first steps' cells.
COARSE = 2
#: A domain whose expected share of the tokens is less holds none to speak of: its posteriors are noise, and it can't be asked for.
LEAST_SHARE = 1e-5
#: A domain is asked for at most so many times the tokens that it has.
MOST_TIMES = 10.0


def posteriors(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", keep: Sequence[str] = (), domains: dict[str, tuple] = DOMAINS, label_columns: Sequence[str] = LABELS) -> DataFrame:
    """(id, keep..., n_tokens, p) with p the posteriors of the domains, stored, for each row of docs(id, keep..., text).

    Of a repeated id in labels each column's largest value counts; a row with a null label belongs to no domain and doesn't count.
    """
    docs = docs.select(id_col, *keep, "text")
    known = labels.filter(F.col(id_col).isNotNull()).groupBy(id_col).agg(*(F.max(c).alias(c) for c in label_columns))
    names = [f"domain{k}" for k in range(len(domains))]
    inside = [reduce(and_, (F.col(c) == v for c, v in zip(label_columns, values, strict=True))).cast("int").alias(n) for n, values in zip(names, domains.values(), strict=True)]
    known = known.dropna(subset=list(label_columns)).select(id_col, *inside)
    found = evidence.features(docs, [id_col, *keep])
    model = evidence.fit(found, known, names, id_col)
    # softmax of the domains' logits, the largest taken off first; a domain of no labelled row has no documents
    seen = [m["rows"] > 0 for m in model.values()]
    logits = F.array(*(F.col(f"e_{n}") + float(np.log(m["prior"] / (1 - m["prior"]))) if there or not any(seen) else F.lit(float("-inf")) for there, (n, m) in zip(seen, model.items(), strict=True)))
    out = evidence.apply(found, model, [id_col, *keep, "n_tokens"]).withColumn("l", logits).withColumn("l", F.transform("l", lambda x: F.exp(x - F.array_max("l"))))
    total = F.aggregate("l", F.lit(0.0), lambda s, x: s + x)
    out = stored(out.select(id_col, *keep, "n_tokens", F.transform("l", lambda x: x / total).alias("p")), "mixing-posteriors", 1 << 15)
    discard(found)
    return out


class Descent:
    """The steps so far: for each, the weighted misses of the domains at which its gradient was taken."""

    def __init__(self, step: float, ridge: float):
        self.step, self.ridge, self.misses, self.momentum, self.t = step, ridge, [], [], 1.0

    def add(self, misses: np.ndarray) -> None:
        t = (1 + (1 + 4 * self.t**2) ** 0.5) / 2
        self.misses.append(misses)
        self.momentum.append((self.t - 1) / t)
        self.t = t

    def rates(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of documents with posteriors p: their rates, and the points at which the next gradient is taken."""
        x = y = np.ones(len(p))
        for g, m in zip(self.misses, self.momentum, strict=True):
            new = np.maximum(0, y - self.step * (p @ g + self.ridge * (y - 1)))
            x, y = new, new + m * (new - x)
        return x, y


def fit_rates(members: DataFrame, targets: Sequence[float], budget: float | None = None, steps: int = STEPS, ridge: float = RIDGE, cells: DataFrame | None = None) -> tuple[Descent, dict]:
    """The descent for members(n_tokens, p), and a report: totals before and after, targets, steps and domains whose targets can't be reached.

    targets: each domain's share of the mix's tokens. budget: tokens of the mix; by default so many that the domain of the
    largest target keeps its expected tokens. cells: members with nearly equal p summed, for the first steps; the last steps,
    two at least, are over members.

    A domain with less than LEAST_SHARE of the tokens has no target: the others' targets keep their proportions. One with less than its
    target asks for is asked for MOST_TIMES its tokens at most. The report names both as unreached. A domain with the target 0 is driven out however
    small it is, with a weight that LEAST_SHARE bounds, so that posteriors near zero don't move rates. Where there are no tokens
    at all, rates stay 1.
    """
    k = len(targets)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    at = lambda i: F.get("p", F.lit(i))
    row = members.agg(F.sum("n_tokens").cast("double"), *(F.sum(F.col("n_tokens") * at(i)) for i in range(k)), *(F.sum(F.col("n_tokens") * at(i) * at(j)) for i, j in pairs)).first()
    total = row[0] or 0.0
    now = np.array([x or 0.0 for x in row[1 : k + 1]])
    share = np.array(targets, np.float64) / sum(targets)
    if not total:
        return Descent(0.0, ridge), {"totals": now, "targets": now, "before": now, "steps": 0, "unreached": []}
    there = now >= LEAST_SHARE * total
    main = int(np.where(there, share, -1.0).argmax())
    wanted = share * (budget if budget is not None else now[main] / share[main] if there[main] and share[main] else 0.0)
    goal = np.minimum(wanted, MOST_TIMES * now)
    asked = there | (share == 0)
    weight = np.where(asked & (now > 0), total / np.maximum(now, LEAST_SHARE * total), 0.0)
    unreached = [i for i in range(k) if share[i] and (not there[i] or goal[i] < wanted[i])]
    gram = np.zeros((k, k))
    for (i, j), x in zip(pairs, row[k + 1 :], strict=True):
        gram[i, j] = gram[j, i] = x / total
    root = np.sqrt(weight)
    descent = Descent(1 / (np.linalg.eigvalsh(root[:, None] * gram * root).max() + ridge), ridge)

    def totals(rows: DataFrame, of: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = np.zeros(k)
            for batch in batches:
                p = batch.column("p").flatten().to_numpy().reshape(-1, k)
                s += (descent.rates(p)[of] * batch.column("n_tokens").to_numpy()) @ p
            yield pa.RecordBatch.from_arrays([pa.array([s.tolist()], pa.list_(pa.float64()))], names=["s"])

        out = rows.select("n_tokens", "p").mapInArrow(run, "s array<double>").agg(*(F.sum(F.get("s", F.lit(i))) for i in range(k))).first()
        return np.array([x or 0.0 for x in out])

    for rows in (members,) if cells is None else (cells, members):
        before = None
        for _ in range(steps):
            held = totals(rows, 1) if descent.misses else now
            descent.add(weight * (held - goal) / total)
            if before is not None and np.abs(held - before).max() <= TOLERANCE * total:
                break
            before = held
    return descent, {"totals": totals(members, 0), "targets": goal, "before": now, "steps": len(descent.misses), "unreached": unreached}


def with_rates(members: DataFrame, descent: Descent, id_col: str = "doc_id", keep: Sequence[str] = ()) -> DataFrame:
    kinds, own = dict(members.dtypes), [id_col, *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column("p").flatten().to_numpy().reshape(batch.num_rows, -1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), batch.column("n_tokens"), batch.column("p"), pa.array(np.round(descent.rates(p)[0], 6))], names=[*own, "n_tokens", "p", "rate"])

    return members.mapInArrow(run, ", ".join(f"`{c}` {kinds[c]}" for c in own) + ", n_tokens long, p array<double>, rate double")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | None = None, id_col: str = "doc_id", keep: Sequence[str] = (), domains: dict[str, tuple] = DOMAINS, label_columns: Sequence[str] = LABELS) -> DataFrame:
    """(id, keep..., n_tokens, p_<domain>..., rate) for each row of docs(id, keep..., text): how often a document is taken on average.

    domains: names, and the values of labels' columns label_columns that make them. targets: shares of the mix's tokens by
    domain, none for the others. A domain of which labels have no row holds no document. Null and empty texts have no tokens and the
    posteriors of their shape. Repeated rows each have their rate.
    """
    members = posteriors(docs, labels, id_col, keep, domains, label_columns)
    near = F.transform("p", lambda x: F.round(x, COARSE))
    # a cell's posteriors are its members' mean, by tokens
    means = F.array(*(F.sum(F.get("p", F.lit(i)) * F.greatest("n_tokens", F.lit(1))) / F.sum(F.greatest("n_tokens", F.lit(1))) for i in range(len(domains))))
    cells = stored(members.groupBy(near.alias("near")).agg(F.sum("n_tokens").alias("n_tokens"), means.alias("p")), "mixing-cells", 1 << 15)
    descent, _ = fit_rates(members, [(targets or TARGETS).get(d, 0.0) for d in domains], budget, cells=cells)
    out = with_rates(members, descent, id_col, keep)
    return out.select(id_col, *keep, "n_tokens", *(F.round(F.get("p", F.lit(i)), 6).alias(f"p_{d}") for i, d in enumerate(domains)), "rate")


def taken(mixed: DataFrame, id_col: str = "doc_id", most: int = 1) -> DataFrame:
    """(id, copies): the rate rounded up or down by a hash of the id, so that the mean is the rate; at most `most` copies."""
    u = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    whole = F.floor("rate")
    return mixed.select(id_col, F.least(whole + (u < F.col("rate") - whole).cast("long"), F.lit(most)).alias("copies"))
