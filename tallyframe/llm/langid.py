"""Language identification with a linear-chain conditional random field over words.

Every word of a text is labelled with a language; neighbouring labels share learned transitions, so
code-switched text is labelled span by span.  Features of a word are its affixes and character
n-grams (1 to 4 code points, the word's two edges being marked) and, for the frequent words of the
training sample, lexicon entries.  Marginals come from forward-backward; a text's language is the one
with the largest sum of marginals over all its words, its score that sum's share.

Training fits the weights on the driver from a bounded sample: ``docs_per_lang`` labelled rows per
language (those with the smallest hash of their id), spliced into sequences of passages of several
languages so that transitions see switches.  Prediction covers every row: one pandas UDF, no shuffle; the
model (``FEATURES`` x languages numbers) travels inside the task function.  A chain is a line, cut every
``CHAIN`` words; all words of whole texts are labelled, so memory is bounded by one text.

Defined cases: null text or text without a letter is ``und`` with score 0, and so is every text if no
row can be learned from; ties go to the language first in order; repeated rows get equal results; an empty table gives no
rows; texts of any length are labelled whole.  Input columns called like the two added ones are replaced by them, in
any case of their letters; columns of any other names stay as they are.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col

WORD = re.compile(r"[^\W\d_]+")
FEATURES, GRAMS, CHAIN, BLOCK = 1 << 16, 4, 128, 200_000


def words_by_line(text: str) -> list[list[str]]:
    """The words of each line, cut to chains; no words if the text has no letter."""
    chains = []
    for line in text.lower().split("\n"):
        words = WORD.findall(line)
        chains += [words[k:k + CHAIN] for k in range(0, len(words), CHAIN)]
    return chains if any(c.isalpha() for chain in chains for w in chain for c in w) else []


def gram_hashes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all n-grams of the words, flat, and the word that each belongs to."""
    flat = np.frombuffer(("\x01" + "\x01".join(words) + "\x01").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    edge = flat == 1
    owner = np.cumsum(edge) - 1
    inner = np.cumsum(edge)
    hashes, owners = [], []
    mixed = np.zeros(len(flat), dtype=np.uint32)
    with np.errstate(over="ignore"):
        for n in range(1, GRAMS + 1):
            size = len(flat) - n + 1
            if size <= 0:
                break
            mixed = (mixed[:size] ^ flat[n - 1:]) * np.uint32(0x9E3779B1)
            mixed ^= mixed >> np.uint32(15)
            if n == 1:
                good = ~edge
            else:  # no edge inside: the edges in [i+1, i+n-2] are none
                good = inner[n - 2:n - 2 + size] == inner[:size]
                if n == 2:
                    good = ~(edge[:size] & edge[1:])
            at = np.flatnonzero(good)
            hashes.append((mixed[at] + np.uint32(n * 7919)) & np.uint32(FEATURES - 1))
            owners.append(owner[at])
    return np.concatenate(hashes), np.concatenate(owners)


class Model:
    """Weights: ``grams`` (FEATURES x L), ``lexicon`` (word -> row of ``entries``), ``moves`` (L x L)."""

    def __init__(self, langs: list[str]):
        n = len(langs)
        self.langs, self.lexicon = langs, {}
        self.grams, self.entries = np.zeros((FEATURES, n), np.float32), np.zeros((0, n), np.float32)
        self.moves = np.zeros((n, n), np.float32)

    def emissions(self, words: list[str]) -> np.ndarray:
        h, owner = gram_hashes(words)
        out = np.empty((len(words), len(self.langs)), dtype=np.float32)
        for k in range(len(self.langs)):
            out[:, k] = np.bincount(owner, weights=self.grams[h, k], minlength=len(words))
        known = [(i, self.lexicon[w]) for i, w in enumerate(words) if w in self.lexicon]
        if known:
            at, rows = np.array(known).T
            out[at] += self.entries[rows]
        return out


def forward_backward(scores: np.ndarray, lens: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of all tokens (chains lie one after another, longest first) and expected moves."""
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    a = np.exp(moves)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    active = np.searchsorted(-lens, -np.arange(lens[0]), side="left")  # chains longer than t
    first = starts
    alpha[first] = e[first] / e[first].sum(axis=1, keepdims=True)
    for t in range(1, int(lens[0])):
        at = starts[:active[t]] + t
        x = (alpha[at - 1] @ a) * e[at]
        alpha[at] = x / x.sum(axis=1, keepdims=True)
    beta[starts + lens - 1] = 1.0
    expected = np.zeros_like(a, dtype=np.float64)
    for t in range(int(lens[0]) - 1, 0, -1):
        at = starts[:active[t]] + t
        y = beta[at] * e[at]
        x = y @ a.T
        beta[at - 1] = x / x.sum(axis=1, keepdims=True)
        pair = alpha[at - 1][:, :, None] * a[None] * y[:, None, :]
        pair /= pair.sum(axis=(1, 2), keepdims=True)
        expected += pair.sum(axis=0)
    m = alpha * beta
    return m / m.sum(axis=1, keepdims=True), expected


def marginals(scores: np.ndarray, lens: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Marginals of all tokens (chains lie one after another, longest first)."""
    starts = np.concatenate([[0], np.cumsum(lens)[:-1]])
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    a = np.exp(moves)
    alpha, beta = np.empty_like(e), np.empty_like(e)
    active = np.searchsorted(-lens, -np.arange(lens[0]), side="left")
    alpha[starts] = e[starts] / e[starts].sum(axis=1, keepdims=True)
    for t in range(1, int(lens[0])):
        at = starts[:active[t]] + t
        x = (alpha[at - 1] @ a) * e[at]
        alpha[at] = x / x.sum(axis=1, keepdims=True)
    beta[starts + lens - 1] = 1.0
    for t in range(int(lens[0]) - 1, 0, -1):
        at = starts[:active[t]] + t
        x = (beta[at] * e[at]) @ a.T
        beta[at - 1] = x / x.sum(axis=1, keepdims=True)
    m = alpha * beta
    return m / m.sum(axis=1, keepdims=True)


def splice(texts: list[tuple[str, str]], langs: list[str], sequences: int, seed: int) -> list[tuple[list[str], list[int]]]:
    """Training chains: one to three passages of 4 to 24 words, each of a random language and text."""
    rng = np.random.default_rng(seed)
    pools: list[list[list[str]]] = [[] for _ in langs]
    for text, lang in texts:
        pools[langs.index(lang)] += [c for c in words_by_line(text)]
    live = [k for k, p in enumerate(pools) if p]
    out = []
    for _ in range(sequences if live else 0):
        words, labels = [], []
        for _ in range(int(rng.integers(1, 4))):
            k = live[int(rng.integers(len(live)))]
            chain = pools[k][int(rng.integers(len(pools[k])))]
            size = int(rng.integers(4, 25))
            at = int(rng.integers(max(1, len(chain) - size + 1)))
            words += chain[at:at + size]
            labels += [k] * len(chain[at:at + size])
        out.append((words, labels))
    return sorted(out, key=lambda s: -len(s[0]))


def fit(texts: list[tuple[str, str]], sequences: int = 12_000, rounds: int = 30, rate: float = 0.5,
        l2: float = 1e-4, lexicon_words: int = 500, seed: int = 42) -> Model:
    """A model from (text, language) rows by full-batch AdaGrad on the regularised log-likelihood."""
    langs = sorted({lang for _, lang in texts})
    model, chains = Model(langs), splice(texts, langs, sequences, seed)
    if not chains:
        return model if len(langs) < 2 else Model([])
    n, types = len(langs), {}
    tokens = np.array([types.setdefault(w, len(types)) for words, _ in chains for w in words])
    gold = np.array([k for _, labels in chains for k in labels])
    lens = np.array([len(words) for words, _ in chains])
    words = list(types)
    for k in range(n):
        count = np.bincount(tokens[gold == k], minlength=len(words))
        for i in np.argsort(-count, kind="stable")[:lexicon_words]:
            if count[i] > 1:
                model.lexicon.setdefault(words[i], len(model.lexicon))
    model.entries = np.zeros((len(model.lexicon), n), np.float32)
    h, owner = gram_hashes(words)
    lex_at = np.array([i for i, w in enumerate(words) if w in model.lexicon], dtype=np.int64)
    lex_row = np.array([model.lexicon[words[i]] for i in lex_at], dtype=np.int64)
    first = np.zeros(len(tokens), dtype=bool)
    first[np.concatenate([[0], np.cumsum(lens)[:-1]])] = True
    follow = np.flatnonzero(~first)
    seen_moves = np.zeros((n, n))
    np.add.at(seen_moves, (gold[follow - 1], gold[follow]), 1.0)
    onehot = np.eye(n)[gold]
    squares = [np.full_like(x, 1e-8, dtype=np.float64) for x in (model.grams, model.entries, model.moves)]
    for _ in range(rounds):
        m, expected = forward_backward(model.emissions(words)[tokens].astype(np.float64), lens, model.moves.astype(np.float64))
        lift = onehot - m
        by_type = np.stack([np.bincount(tokens, weights=lift[:, k], minlength=len(words)) for k in range(n)], axis=1)
        grads = [np.stack([np.bincount(h, weights=by_type[owner, k], minlength=FEATURES) for k in range(n)], axis=1),
                 np.zeros((len(model.lexicon), n)), seen_moves - expected]
        grads[1][lex_row] = by_type[lex_at]
        for w, g, s in zip((model.grams, model.entries, model.moves), grads, squares):
            g = g / len(tokens) - l2 * w
            s += g * g
            w += (rate * g / np.sqrt(s)).astype(np.float32)
    return model


def predict_texts(model: Model, texts: list[str | None]) -> list[tuple[str, float]]:
    """(language, score) of each text."""
    out = [("und", 0.0)] * len(texts)
    block: list[tuple[int, list[list[str]]]] = []
    held = 0
    for i, text in enumerate(texts):
        chains = words_by_line(text) if text and model.langs else []
        if chains:
            block.append((i, chains))
            held += sum(map(len, chains))
        if held >= BLOCK:
            _predict_block(model, block, out)
            block, held = [], 0
    if block:
        _predict_block(model, block, out)
    return out


def _predict_block(model: Model, block: list[tuple[int, list[list[str]]]], out: list[tuple[str, float]]) -> None:
    chains = sorted(((len(c), i, c) for i, cs in block for c in cs), key=lambda x: -x[0])
    lens = np.array([x[0] for x in chains])
    flat = [w for _, _, c in chains for w in c]
    uniq = list(dict.fromkeys(flat))
    number = dict(zip(uniq, range(len(uniq))))
    tokens = np.fromiter(map(number.__getitem__, flat), np.int64, len(flat))
    m = marginals(model.emissions(uniq)[tokens], lens, model.moves)
    doc = np.repeat(np.array([x[1] for x in chains]), lens)
    ids = [i for i, _ in block]
    where = np.searchsorted(ids, doc)
    sums = np.stack([np.bincount(where, weights=m[:, k], minlength=len(ids)) for k in range(len(model.langs))], axis=1)
    best = sums.argmax(axis=1)
    for j, i in enumerate(ids):
        out[i] = (model.langs[best[j]], min(1.0, float(sums[j, best[j]] / sums[j].sum())))


def label_words(model: Model, text: str) -> list[tuple[str, str, float]]:
    """(word, language, marginal) of every word of a text, in order: spans of code-switched text."""
    out = []
    for chain in words_by_line(text):
        m = marginals(model.emissions(chain), np.array([len(chain)]), model.moves)
        out += [(w, model.langs[k], float(p)) for w, k, p in zip(chain, m.argmax(axis=1), m.max(axis=1))]
    return out


def training_rows(docs: DataFrame, use: Column, docs_per_lang: int, id_col: str, text_col: str, lang_col: str) -> list[tuple[str, str]]:
    """The ``docs_per_lang`` labelled rows of each language with the smallest hash of their id."""
    narrow = docs.where(use & col(lang_col).isNotNull()).select(col(lang_col).alias("lang"), F.xxhash64(col(id_col).cast("string")).alias("h"))
    # a language may hold most rows: the smallest hashes of each of 64 shares come first, then those of the language
    shares = narrow.withColumn("share", F.pmod("h", F.lit(64))).groupBy("lang", "share", "h").agg(F.count("*").alias("rows"))
    for keys in (["lang", "share"], ["lang"]):
        least = F.row_number().over(Window.partitionBy(*keys).orderBy("h"))
        shares = shares.withColumn("n", least).where(F.col("n") <= docs_per_lang)
    last = shares.groupBy("lang").agg(F.max("h").alias("last")).collect()
    pick = F.lit(False)
    for r in last:
        pick = pick | ((col(lang_col) == r["lang"]) & (F.xxhash64(col(id_col).cast("string")) <= r["last"]))
    rows = (docs.where(use & col(text_col).isNotNull() & pick)
            .select(col(id_col).alias("id"), col(text_col).alias("text"), col(lang_col).alias("lang"))
            .groupBy("id", "lang").agg(F.min("text").alias("text")).collect())
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (str(r["id"]), r["lang"]))]


def identify(docs: DataFrame, train_on: Column | None = None, docs_per_lang: int = 150, id_col: str = "doc_id",
             text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``docs`` with lang_pred and score (columns of these names are replaced).

    The model learns from rows where ``train_on`` holds (all, if not given) and the language is known.
    It travels inside the task function, so that executors need not have the library.
    """
    use = F.lit(True) if train_on is None else F.coalesce(train_on, F.lit(False))
    model = fit(training_rows(docs, use, docs_per_lang, id_col, text_col, lang_col))

    @F.pandas_udf("lang_pred string, score double")
    def predict(text):
        import pandas as pd
        return pd.DataFrame(predict_texts(model, [t if isinstance(t, str) else None for t in text]), columns=["lang_pred", "score"])

    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    found = docs.select(F.struct(*[col(c) for c in kept]).alias("row"), predict(col(text_col)).alias("found"))
    return found.select("row.*", "found.lang_pred", "found.score")
