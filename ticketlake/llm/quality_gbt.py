"""Quality rules: gradient-boosted trees over document statistics.

One Arrow-batched pass computes the statistics of every whole text. The trees
are trained in numpy on a bounded sample of labelled documents
(`max_train_rows`, the documents whose id has the smallest hash), with
monotonic constraints on chosen statistics, and flattened into node arrays, so
scoring is `depth` vectorised gathers a tree. The model is a few kilobytes; no
shuffle but the sample's top-n.

Defined cases: a null text is an empty text (no words, base rules failed); a
null or repeated doc_id is a row like any other; labels that are null are not
used, of several labels for a document the lowest counts; without labels of
both classes the model keeps whatever the base rules keep; very long texts are
read whole; of equal splits the first statistic and threshold win; an empty table
gives an empty result. Helper columns take names that the table does not have.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlake.llm.common import by_value, col, fresh

by_value(__name__)

#: Statistics in model order, and the sign of the effect each may have on the
#: probability of being good (0: free).
FEATURES = ["log_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share",
            "punct_share", "distinct_share", "top_word_share", "words_per_line", "exclaim_share"]
MONOTONE = [0, 0, -1, -1, -1, -1, 0, 0, 0, -1, 0, -1]

SYMBOLS = b"#*$%&|<>"
_UPPER, _DIGIT = bytes(range(65, 91)), bytes(range(48, 58))
_PUNCT = bytes(i for i in range(33, 127) if not chr(i).isalnum())
_SPACE = b" \t\n\x0b\x0c\r"

BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"


def repeated_words(words: list[bytes], n: int = 3) -> int:
    """Words inside n-word windows that occur twice or more among `words`."""
    size = len(words)
    if size < n + 1:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, size)
    key, base = a[: size - n + 1], len(ids)
    for i in range(1, n):
        if int(key.max()) > (1 << 62) // (base + 1):
            key = np.unique(key, return_inverse=True)[1]
        key = key * base + a[i: size - n + 1 + i]
    _, inv, cnt = np.unique(key, return_inverse=True, return_counts=True)
    rep = cnt[inv] > 1
    if not rep.any():
        return 0
    covered = np.zeros(size, bool)
    for i in range(n):
        covered[i: size - n + 1 + i] |= rep
    return int(covered.sum())


def text_stats(text: str | None) -> tuple[list[int], list[float]]:
    """The five base counts and the model's statistics of one text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    bare = size - len(raw.translate(None, _SPACE))
    chars = len(text or "") - bare
    symbols = size - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    counts = Counter(words)
    letters = max(chars, 1)
    share = lambda drop: (size - len(raw.translate(None, drop))) / letters
    return [n, chars, symbols, dup, repeat], [
        float(np.log1p(n)), chars / max(n, 1), symbols / letters, dup / max(len(lines), 1), repeat / max(n, 1),
        share(_UPPER), share(_DIGIT), share(_PUNCT), len(counts) / max(n, 1), max(counts.values(), default=0) / max(n, 1),
        n / max(len(lines), 1), raw.count(b"!") / max(n, 1)]


def base_failed(n_words: int, n_repeat: int, min_words: int = 50, max_repeat_pct: int = 50) -> bool:
    return n_words < min_words or 100 * n_repeat > max_repeat_pct * n_words


# ------------------------------------------------------------------ training

def train_trees(x: np.ndarray, y: np.ndarray, *, monotone: list[int], n_trees: int = 60, depth: int = 4,
                rate: float = 0.15, lam: float = 1.0, bins: int = 48, min_leaf: int = 20) -> dict[str, np.ndarray]:
    """Second-order boosting of complete trees on binned features.

    A split on a constrained feature must order its two leaf values, and their
    midpoint bounds all values below it, so the summed score is monotonic in
    the feature. Returns flat arrays: `feature`, `cut` (trees x inner nodes),
    `leaf` (trees x leaves), `bias`."""
    rows, dims = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(dims)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(dims)], 1)
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, cut = np.zeros((n_trees, inner), np.int32), np.full((n_trees, inner), np.inf)
    leaf = np.zeros((n_trees, leaves))
    bias = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score = np.full(rows, bias)
    for t in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        at = np.zeros(rows, np.int64)
        low, high = np.full(1, -np.inf), np.full(1, np.inf)
        for d in range(depth):
            width = 1 << d
            best_gain, best_f, best_b = np.full(width, 1e-6), np.zeros(width, int), np.full(width, -1)
            best_mid = np.zeros(width)
            for f in range(dims):
                nb = len(cuts[f]) + 1
                if nb < 2:
                    continue
                k = at * nb + binned[:, f]
                gs = np.bincount(k, g, width * nb).reshape(width, nb).cumsum(1)
                hs = np.bincount(k, h, width * nb).reshape(width, nb).cumsum(1)
                ns = np.bincount(k, minlength=width * nb).reshape(width, nb).cumsum(1)
                gl, hl, nl = gs[:, :-1], hs[:, :-1], ns[:, :-1]
                gr, hr, nr = gs[:, -1:] - gl, hs[:, -1:] - hl, ns[:, -1:] - nl
                wl = np.clip(gl / (hl + lam), low[:, None], high[:, None])
                wr = np.clip(gr / (hr + lam), low[:, None], high[:, None])
                w0 = np.clip(gs[:, -1:] / (hs[:, -1:] + lam), low[:, None], high[:, None])
                worth = lambda gg, hh, w: 2 * gg * w - (hh + lam) * w * w
                gain = worth(gl, hl, wl) + worth(gr, hr, wr) - worth(gs[:, -1:], hs[:, -1:], w0)
                gain[(nl < min_leaf) | (nr < min_leaf) | (monotone[f] * (wr - wl) < 0)] = -np.inf
                b = gain.argmax(1)
                got = gain[np.arange(width), b]
                better = got > best_gain
                best_gain[better], best_f[better], best_b[better] = got[better], f, b[better]
                best_mid[better] = ((wl + wr) / 2)[np.arange(width), b][better]
            lo2, hi2 = np.repeat(low, 2), np.repeat(high, 2)
            for node in range(width):
                if best_b[node] < 0:
                    continue
                f = best_f[node]
                feature[t, width - 1 + node], cut[t, width - 1 + node] = f, cuts[f][best_b[node]]
                if monotone[f] > 0:
                    hi2[2 * node], lo2[2 * node + 1] = best_mid[node], best_mid[node]
                elif monotone[f] < 0:
                    lo2[2 * node], hi2[2 * node + 1] = best_mid[node], best_mid[node]
            low, high = lo2, hi2
            inner_at = width - 1 + at
            at = 2 * at + (x[np.arange(rows), feature[t, inner_at]] > cut[t, inner_at])
        gs, hs = np.bincount(at, g, leaves), np.bincount(at, h, leaves)
        leaf[t] = rate * np.clip(gs / (hs + lam), low, high)
        score += leaf[t, at]
    return {"feature": feature, "cut": cut, "leaf": leaf, "bias": np.float64(bias)}


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Probability of being good for each row of statistics."""
    score = np.full(len(x), float(model["bias"]))
    rows = np.arange(len(x))
    depth = int(np.log2(model["leaf"].shape[1])) if len(model["leaf"]) else 0
    for feature, cut, leaf in zip(model["feature"], model["cut"], model["leaf"]):
        at = np.zeros(len(x), np.int64)
        for d in range(depth):
            node = (1 << d) - 1 + at
            at = 2 * at + (x[rows, feature[node]] > cut[node])
        score += leaf[at]
    return 1 / (1 + np.exp(-score))


def _keep_all() -> dict[str, np.ndarray]:
    return {"feature": np.zeros((0, 1), np.int32), "cut": np.zeros((0, 1)), "leaf": np.zeros((0, 2)),
            "bias": np.float64(30.0), "threshold": np.float64(0.0)}


def _features(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([text_stats(t)[1] for t in texts], dtype=object)
    return stats(text)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        label_col: str = "quality", max_train_rows: int = 20_000, good_loss: float = 0.002, **kw) -> dict[str, np.ndarray]:
    """Train on at most `max_train_rows` labelled documents (1 good, 0 bad).

    The verdict's threshold is 0.5, or the probability below which only a
    `good_loss` share of the labelled good documents falls, if that is less.
    """
    lab = (labels.select(col(id_col).alias("_id"), col(label_col).cast("int").alias("_y"))
                 .where("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.min("_y").alias("_y"))
                 .orderBy(F.xxhash64("_id"), "_id").limit(max_train_rows))
    got = (docs.select(col(id_col).alias("_id"), col(text_col).alias("_text"))
               .join(F.broadcast(lab), "_id")             # at most max_train_rows rows
               .select("_id", "_y", _features(F.col("_text")).alias("_x"))
               .orderBy(F.xxhash64("_id"), "_id", "_x").limit(max_train_rows).toPandas())
    if len(got) == 0 or got["_y"].nunique() < 2:
        return _keep_all()
    x, y = np.array(got["_x"].tolist(), float), (got["_y"].to_numpy() > 0).astype(float)
    model = train_trees(x, y, monotone=MONOTONE, **kw)
    model["threshold"] = np.float64(min(0.5, np.quantile(predict(model, x)[y == 1], good_loss)))
    return model


def verdicts(text: Column, model: dict[str, np.ndarray]) -> Column:
    """STRUCT of the base counts, `base_failed`, `p_good` and `kept`."""
    @F.pandas_udf(f"{BASE}, p_good double, kept boolean")
    def judge(texts: pd.Series) -> pd.DataFrame:
        got = [text_stats(t) for t in texts]
        out = pd.DataFrame([g[0] for g in got], columns=["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"],
                           dtype="int64")
        out["base_failed"] = [base_failed(g[0][0], g[0][4]) for g in got]
        p = predict(model, np.array([g[1] for g in got], float).reshape(len(got), len(FEATURES)))
        out["p_good"] = p
        out["kept"] = ~out["base_failed"].to_numpy(bool) & (p >= float(model["threshold"]))
        return out
    return judge(text)


def keep_good(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents that the rules keep, with their columns."""
    v = fresh(docs, "_verdict")
    model = fit(docs, labels, id_col=id_col, text_col=text_col, **kw)
    return docs.withColumn(v, verdicts(col(text_col), model)).where(col(v)["kept"]).drop(v)
