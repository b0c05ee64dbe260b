"""A classifier over hashed features of texts, fitted from a table of labelled documents: grouped counts choose features, a logistic regression weighs them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  (pa.compute)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from itemloom.llm.common import BoundedCache, cut_long, stored, texts_of

#: Features are hashed into so many places; the model is at most so many weights for each label.
PLACES = 1 << 17
#: Features whose share of documents differs between a label's two values by fewer standard errors have no weight.
LEAST_Z = 5.0
#: At most so many features of a label have a weight, and about so many labelled rows are sent to the driver to find it.
MOST_TELLING, SAMPLE = 2000, 20_000
#: A document's evidence is kept within this many logits.
MOST_LOGIT = 20.0

#: Bytes of texts that are looked at together; longer texts are cut at white space.
CHUNK = 1 << 20
_KIND = np.full(256, 2, np.uint8)  # signs
_KIND[[*b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", *range(128, 256)]] = 1
_KIND[[9, 10, 11, 12, 13, 32]] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Of a text: its runs, words between white space, bytes that aren't white space, capitals, signs and line ends.
SHAPE = ("runs", "words", "solid", "capitals", "signs", "lines")


def distinct_runs(pieces: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Of all pieces: the distinct runs of lower-cased word characters, or of up to four signs; the place among these of each run;
    how many runs come before each piece; and the numbers of SHAPE, a row for each piece."""
    raw = np.frombuffer(b"\n".join(pieces), np.uint8)
    begins = np.cumsum([0, *(len(x) + 1 for x in pieces[:-1])])
    ends = begins + [len(x) for x in pieces]
    kind = _KIND[raw]
    first = kind > 0
    solid = first.copy()
    words = first.copy()
    words[1:] &= ~solid[:-1]
    first[1:] &= kind[1:] != kind[:-1]
    sign = np.flatnonzero(kind == 2)
    starts = np.flatnonzero(first & (kind == 2))
    first[sign[(sign - starts[np.searchsorted(starts, sign, "right") - 1]) % 4 == 0]] = True
    at = np.flatnonzero(first)
    counted = (at, np.flatnonzero(words), np.flatnonzero(solid), np.flatnonzero((raw >= 65) & (raw <= 90)), sign, np.flatnonzero(raw == 10))
    shape = np.stack([np.searchsorted(x, ends) - np.searchsorted(x, begins) for x in counted], axis=1)
    data = _LOWER[raw[solid]]
    offsets = np.append(np.flatnonzero(first[solid]), len(data)).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return runs.dictionary.to_pylist(), runs.indices.to_numpy(), np.searchsorted(at, begins), shape


class Features:
    """Places of texts' distinct features: lower-cased words, runs of other signs, and each text's shape."""

    def __init__(self, places: int = PLACES):
        import xxhash

        digest = xxhash.xxh64_intdigest
        self.cache = BoundedCache(lambda w: digest(w, 1) % places, 300_000)

    def __call__(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[int]]:
        """For each text its sorted places and its number of words between ASCII white space."""
        found: list[list[np.ndarray]] = [[] for _ in texts]
        shapes = np.zeros((len(texts), len(SHAPE)), np.int64)
        held, size = [], 0
        for k, t in enumerate(texts):
            for piece in cut_long((t or "").encode(), CHUNK):
                held.append((k, piece))
                size += len(piece)
                if size >= CHUNK:
                    self.add(held, found, shapes)
                    held, size = [], 0
        if held:
            self.add(held, found, shapes)
        get, out = self.cache.__getitem__, []
        for parts, (n, _, solid, capitals, signs, lines) in zip(found, shapes.tolist(), strict=True):
            own = np.unique(np.concatenate([np.zeros(0, np.int64), *parts]))
            shape = (
                b"\0length%d" % n.bit_length(), b"\0repeat%d" % (10 * len(own) // max(n, 1)), b"\0capital%d" % (20 * capitals // max(solid, 1)),
                b"\0sign%d" % (40 * signs // max(solid, 1)), b"\0lines%d" % (20 * lines // max(n, 1)),
            )
            out.append(np.union1d(own, np.fromiter(map(get, shape), np.int64, len(shape))))
        return out, shapes[:, 1].tolist()

    def add(self, held: list[tuple[int, bytes]], found: list[list[np.ndarray]], shapes: np.ndarray) -> None:
        names, at, before, shape = distinct_runs([piece for _, piece in held])
        places = np.fromiter(map(self.cache.__getitem__, names), np.int64, len(names))
        cuts = [*before.tolist(), len(at)]
        for i, (k, _) in enumerate(held):
            found[k].append(places[np.unique(at[cuts[i] : cuts[i + 1]])])
            shapes[k] += shape[i]


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """docs' columns `keep`, n_tokens (words between ASCII white space) and places, the sorted distinct features of docs' text; stored.

    Texts are read once and never shuffled: what follows moves only places. Null texts are empty texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features()
        for batch in batches:
            found, n = of(texts_of(batch.column("text")))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *found]).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(n, pa.int64()), lists], names=[*keep, "n_tokens", "places"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_tokens long", "places array<int>"])
    return stored(docs.select(*keep, "text").mapInArrow(run, schema), "evidence-features")


def _lists(column: pa.Array) -> list[np.ndarray]:
    """Views of a list column's values, row by row."""
    values, ends = column.flatten().to_numpy(), np.cumsum(pa.compute.list_value_length(column).to_numpy(zero_copy_only=False))
    return np.split(values, ends[:-1]) if len(ends) else []


def fit(found: DataFrame, known: DataFrame, labels: list[str], id_col: str = "doc_id", sample: int = SAMPLE) -> dict[str, dict]:
    """For each 0/1 label column of known(id, labels...): its prior and the weights of telling features of found(id, places).

    Which features tell is found by grouped counts over every labelled row: each task sends its counts, and the driver gets
    the MOST_TELLING features of a label whose shares differ most surely. Their weights are those of a logistic regression
    on about `sample` rows, chosen by a hash of the id. known has an id once. Rows with a null label don't count for it; a
    label with one value has no weights.
    """
    pairs = found.select(id_col, "places")
    labelled = pairs.join(known.hint("merge"), id_col)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros((PLACES + 1, 2 * len(labels)), np.int64)
        for batch in batches:
            values = [batch.column(c).to_pylist() for c in labels]
            for i, at in enumerate(_lists(batch.column("places"))):
                at = np.append(at, PLACES)
                for k, column in enumerate(values):
                    if column[i] is not None:
                        table[at, 2 * k + (column[i] > 0)] += 1
        used = np.flatnonzero(table.any(axis=1))
        for i in range(0, len(used), 8192):
            part = used[i : i + 8192]
            yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(table[part, k]) for k in range(2 * len(labels)))], names=["place", *names])

    names = [f"c{k}" for k in range(2 * len(labels))]
    summed = labelled.select("places", *labels).mapInArrow(counts, "place long, " + ", ".join(f"{c} long" for c in names)).groupBy("place").agg(*(F.sum(c).alias(c) for c in names))
    summed = stored(summed, "evidence-counts")
    total = summed.filter(F.col("place") == PLACES).first() or dict.fromkeys(names, 0)
    told = {}
    for k, label in enumerate(labels):
        n0, n1 = total[f"c{2 * k}"], total[f"c{2 * k + 1}"]
        p0, p1 = F.col(f"c{2 * k}") / max(n0, 1), F.col(f"c{2 * k + 1}") / max(n1, 1)
        mean = (F.col(f"c{2 * k}") + F.col(f"c{2 * k + 1}") + 0.5) / (n0 + n1 + 1)
        z = F.abs(p1 - p0) / F.sqrt(mean * (1 - mean) * (1 / max(n0, 1) + 1 / max(n1, 1)))
        telling = summed.filter((F.col("place") < PLACES) & (z >= LEAST_Z)).orderBy(z.desc(), "place").limit(MOST_TELLING)
        told[label] = sorted(r[0] for r in telling.select("place").collect()) if n0 and n1 else []
    chosen = np.unique(np.concatenate([np.array(x, np.int64) for x in told.values()]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.intersect1d(x, chosen, assume_unique=True).tolist() for x in _lists(batch.column("places"))]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int64())), *(batch.column(c) for c in labels)], names=["places", *labels])

    share = min(1.0, sample / max(total["c0"] + total["c1"], 1))
    chosen_rows = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.lit("fit")), F.lit(1 << 20)) < int(share * (1 << 20)) + (share >= 1)
    # of a repeated id one row counts, the least by its places
    part = pairs.filter(chosen_rows).groupBy(id_col).agg(F.min("places").alias("places")).join(known.filter(chosen_rows).hint("merge"), id_col)
    held = part.select("places", *labels).mapInArrow(rows, "places array<long>, " + ", ".join(f"{c} int" for c in labels)).toArrow() if len(chosen) else None
    model = {}
    for k, label in enumerate(labels):
        n0, n1 = total[f"c{2 * k}"], total[f"c{2 * k + 1}"]
        model[label] = {"prior": (n1 + 0.5) / (n0 + n1 + 1), "rows": n1, "weights": {}, "shift": 0.0}
        if told[label]:
            y = held.column(label).to_pylist()
            ok = [i for i, v in enumerate(y) if v is not None]
            places = np.array(told[label])
            sets = held.column("places").to_pylist()
            w, bias = logistic([np.searchsorted(places, np.intersect1d(sets[i], places)) for i in ok], np.array([y[i] > 0 for i in ok], float), len(places))
            model[label] |= {"weights": dict(zip(places.tolist(), np.round(w, 9).tolist(), strict=True)), "shift": round(bias - float(np.log(model[label]["prior"] / (1 - model[label]["prior"]))), 9)}
    return model


def logistic(sets: list[np.ndarray], y: np.ndarray, n_features: int, steps: int = 300, ridge: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on sets of features, by accelerated gradients on scaled features."""
    cols = np.concatenate([*sets, np.zeros(0, np.int64)]).astype(np.int64)
    rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    scale = 1 / np.sqrt(np.maximum(np.bincount(cols, minlength=n_features) / max(len(y), 1), 1 / max(len(y), 1)))
    values = scale[cols]
    dot = lambda v: np.bincount(rows, v[cols] * values, minlength=len(y))
    back = lambda r: np.bincount(cols, r[rows] * values, minlength=n_features)
    v = np.ones(n_features)
    for _ in range(20):
        v = back(dot(v))
        top = np.linalg.norm(v)
        v = v / max(top, 1e-12)
    step = 1 / (0.25 * (top / len(y) + 1) + ridge)
    w = look = np.zeros(n_features)
    b = look_b = float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)))
    for k in range(steps):
        miss = (1 / (1 + np.exp(-np.clip(dot(look) + look_b, -50, 50))) - y) / len(y)
        new, new_b = look - step * (back(miss) + ridge * look), look_b - step * miss.sum()
        m, moved = k / (k + 3), np.abs(new - w).max(initial=0.0)
        look, look_b, w, b = new + m * (new - w), new_b + m * (new_b - b), new, new_b
        if k > 20 and moved <= 1e-4 * np.abs(w).max(initial=1.0):
            break
    return w * scale, b


def apply(found: DataFrame, model: dict[str, dict], keep: list[str]) -> DataFrame:
    """found's columns `keep` and one column of logits `e_<label>` for each label: the evidence alone, without the label's prior."""
    labels = list(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.zeros((PLACES, len(labels)))
        for k, label in enumerate(labels):
            w = model[label]["weights"]
            weights[np.fromiter(w.keys(), np.int64, len(w)), k] = list(w.values())
        for batch in batches:
            e = np.array([weights[x].sum(axis=0) for x in _lists(batch.column("places"))]).reshape(batch.num_rows, len(labels))
            e = np.clip(e + [model[x]["shift"] for x in labels], -MOST_LOGIT, MOST_LOGIT)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *(pa.array(e[:, k]) for k in range(len(labels)))], names=[*keep, *(f"e_{x}" for x in labels)])

    kinds = dict(found.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), *(f"e_{x} double" for x in labels)])
    return found.select(*keep, "places").mapInArrow(run, schema)
