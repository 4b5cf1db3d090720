"""The pipeline's rows, and the language models within it, against plain versions of every stage."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from test_llm_operators import WORD, brute_components

from fieldwright.llm import decontaminate, language_id, tokens

DDL = "doc_id long, text string, lang string, source string, n_chars long"


def corpus() -> tuple[list[tuple], list[tuple]]:
    r = random.Random(21)
    vocab = {k: ["".join(r.choice(s) for _ in range(r.randint(2, 6))) for _ in range(250)] for k, s in (("aa", "abcdefgh"), ("bb", "ghijklmn"))}

    def prose(lang, n):
        return " ".join(r.choice(vocab[lang]) for _ in range(n))

    items = [prose("aa", 20), prose("bb", 30), prose("aa", 9), "", None]
    rows = []
    for i in range(120):
        lang = r.choice(["aa", "bb"])
        rows.append((prose(lang, r.choice([1, 3, 20, 60, 120])), lang, r.choice(["s1", "s2", "s3", None])))
    chain = [prose("aa", 60)]
    chain += [f"{chain[0]} {prose('aa', 12)}"]
    chain += [f"{chain[1]} {prose('aa', 14)}"]
    rows += [(t, "aa", "s2") for t in chain]  # the first and the last are linked through the second alone
    rows += [(rows[i][0], rows[i][1], "s1") for i in (0, 1, 2, 2, 2)]  # exact copies
    rows += [(f"{t} {prose(k, 1)}", k, s) for t, k, s in rows[:40]]  # near copies, where the text is long enough
    rows.append((prose("bb", 3000), "bb", "s3"))
    part = items[1].split()
    part[8], part[11] = "other", "words"
    rows += [(f"{prose('aa', 30)} {items[0].upper()} {prose('aa', 30)}", "aa", "s1"), (f"{prose('bb', 30)} {' '.join(part[5:18])}", "bb", "s2"), (f"{prose('aa', 30)} {' '.join(items[2].split()[:8])}", "aa", "s2")]
    rows += [(None, None, None), ("", "aa", "s1"), ("12 34 %%", "bb", "s2"), ("xyz zzyx wvyz qrst vwxyz ttuv qqrs " * 5, None, "s1"), ("你好 世界 再见 " * 10, None, "s3")]
    ids = r.sample(range(1000), len(rows))
    return [(i, t, lang, s, len(t or "")) for i, (t, lang, s) in zip(ids, rows, strict=True)], list(enumerate(items))


ROWS, ITEMS = corpus()


def sequences(text: str) -> list[tuple]:
    """Letter runs of a text's words, each with start marks and an end mark."""
    n = language_id.ORDER - 1
    out = []
    for word in WORD.findall(text.encode()):
        run: list = []
        for c in [*word.decode().lower(), None]:
            if c is not None and c.isalpha():
                run.append(c)
            elif run:
                out.append(("<",) * n + (*run, ">"))
                run = []
    return out


class PlainModel:
    """Interpolated Kneser-Ney over dictionaries, written from its formula."""

    def __init__(self, texts: list[str]):
        order = language_id.ORDER
        highest = Counter(s[i - order + 1 : i + 1] for t in texts for s in sequences(t) for i in range(order - 1, len(s)))
        counts = [Counter() for _ in range(order - 1)] + [highest]
        for k in range(order - 1, 0, -1):
            for gram in counts[k]:
                counts[k - 1][gram[1:]] += 1
        self.counts = counts
        self.total, self.kinds, self.discount = [], [], []
        for table in counts:
            total, kinds = Counter(), Counter()
            for gram, n in table.items():
                total[gram[:-1]] += n
                kinds[gram[:-1]] += 1
            one, two = (sum(n == x for n in table.values()) for x in (1, 2))
            self.total.append(total)
            self.kinds.append(kinds)
            self.discount.append(min(max(one / (one + 2 * two), 0.1), 0.95) if one + two else 0.5)

    def p(self, gram: tuple) -> float:
        lower = self.p(gram[1:]) if len(gram) > 1 else 1 / 200
        k = len(gram) - 1
        total = self.total[k][gram[:-1]]
        if not total:
            return lower
        return max(self.counts[k][gram] - self.discount[k], 0) / total + self.discount[k] * self.kinds[k][gram[:-1]] / total * lower

    def entropy(self, text: str) -> tuple[float, int]:
        """Cross-entropy for each predicted symbol, and the number of those."""
        n = language_id.ORDER
        logs = [math.log(self.p(s[i - n + 1 : i + 1])) for s in sequences(text) for i in range(n - 1, len(s))]
        return -sum(logs) / max(len(logs), 1), len(logs)


def identified(sample: list[tuple[str, str]]) -> dict:
    """For each document: language, cross-entropy, whether it is rejected, and how far it is from that."""
    by = defaultdict(list)
    for lang, text in sample:
        by[lang].append(text)
    models, limit = {}, {}
    for lang, texts in by.items():
        models[lang] = PlainModel([t for i, t in enumerate(texts) if i % language_id.CALIBRATION])
    own, strange = {}, defaultdict(list)
    for lang, texts in by.items():
        apart = texts[:: language_id.CALIBRATION]
        own[lang] = np.quantile([models[lang].entropy(t)[0] for t in apart], 0.99)
        for t in apart:  # as if its language had not been learned
            h, other = min((models[x].entropy(t)[0], x) for x in sorted(models) if x != lang)
            strange[other].append(h)
    every = [h for x in strange.values() for h in x]
    for lang in by:
        limit[lang] = max(own[lang], (own[lang] + np.quantile(strange[lang] or every, 0.05)) / 2)
    out = {}
    for i, text, *_ in ROWS:
        scores = {lang: m.entropy(text or "") for lang, m in sorted(models.items())}
        best = min(scores, key=lambda x: scores[x][0])
        h, n = scores[best]
        if n:
            room = limit[best] + 3 / math.sqrt(n) - h
            out[i] = (best, h, room < 0, abs(room))
        else:
            out[i] = ("und", None, True, 9.0)
    return out


def contaminated(text: str, items: list[str]) -> bool:
    def words(t):
        return [w.lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t)]

    w = words(text)
    for item in map(words, items):
        size = min(len(item), decontaminate.WINDOW)
        for i in range(len(item) - size + 1):
            for j in range(len(w) - size + 1):
                if size and 100 * sum(a == b for a, b in zip(item[i : i + size], w[j : j + size], strict=True)) >= decontaminate.PERCENT * size:
                    return True
    return False


def mixed(rows: list[tuple]) -> list[tuple[int, str]]:
    """Each document as often as the mix takes any of its words."""
    size = {i: len(WORD.findall(t.encode())) for i, t, *_ in rows}
    source_size = Counter()
    for i, _, _, s, _ in rows:
        source_size[s] += size[i]
    sources = sorted(source_size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sources)}
    left, target, rest = Fraction(3 * sum(source_size.values()), 2), {}, set(sources)
    while rest:
        level = left / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] >= 2 * source_size[s]]
        if not over:
            target |= {s: level * weight[s] for s in rest}
            break
        for s in over:
            target[s] = Fraction(2 * source_size[s])
            left -= target[s]
            rest.remove(s)
    out = []
    for s in sources:
        queue = sorted(((hashlib.md5(f"{i}|0".encode()).hexdigest(), i, t) for i, t, _, x, _ in rows if x == s))
        start = 0
        for _ in range(2):
            for _, i, t in queue:
                if size[i] and start < math.floor(target[s]):
                    out.append((i, t))
                start += size[i]
    return out


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('pipeline')}"
    spark.createDataFrame(ROWS, DDL).repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def languages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    sample = language_id.training_sample(docs, "doc_id", "text", "lang")
    learnable = [(lang, t) for i, t, lang, *_ in ROWS if t and lang and zlib.crc32(str(i).encode()) % 4 != 2]
    assert sorted(sample) == sorted(learnable)
    return identified(sample)


def test_language_models_by_formula(spark, folder, languages):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r for r in language_id.identify_language(docs, language_id.learn(docs)).collect()}
    assert got.keys() == languages.keys()
    for i, (lang, h, rejected, room) in languages.items():
        assert room > 1e-3, "the fixture must not stand on the limit"
        assert (got[i]["lang_pred"], got[i]["rejected"]) == (lang, rejected)
        assert got[i]["cross_entropy"] == (None if h is None else pytest.approx(h, abs=1e-4))
    assert sum(r and h is not None for _, h, r, _ in languages.values()) == 2  # foreign letters


def test_pipeline_by_brute_force(spark, folder, languages):
    import corpus_pipeline
    from tokenizers import Tokenizer

    kept = [r for r in ROWS if not languages[r[0]][2]]
    component = brute_components(kept)
    alone = [r for r in kept if component[r[0]][1] == r[0]]
    clean = [r for r in alone if not contaminated(r[1], [t for _, t in ITEMS if t])]
    assert len(ROWS) > len(kept) > len(alone) > len(clean) == len(alone) - 2
    coder = Tokenizer.from_file(tokens.tokenizer_path())
    want, start = [], 0
    for i, t in sorted(mixed(clean)):
        ids = [*coder.encode(t, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in corpus_pipeline.run(spark, folder).collect())
    assert got == sorted(want)


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], DDL).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
