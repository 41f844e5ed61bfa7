"""Every stage of the pipeline against plain Python, on documents planted for it."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as E
import corpus_pipeline
from llm_fixtures import SCHEMA, docs, none, prose, rows  # noqa: F401
from wardrank.llm.queries import tokenizers

ITEM = "the quick answer of every planted benchmark item is forty two exactly as written"
N = 300


def _planted():
    """Clean texts (0-), toxic (1000-), copies and near copies (2000-), a
    repeated passage of 55 words (3000-), a benchmark passage (4000-)."""
    rng = random.Random(11)
    texts = {i: prose(rng, rng.randrange(20, 160)) for i in range(N)}
    for i in range(60):
        texts[1000 + i] = prose(rng, 30) + f" vilescum{i % 2} " + prose(rng, 30)
    for i in range(8):
        words = texts[i].split(" ")
        words[len(words) // 2] = "edited"
        texts[2000 + i] = texts[i] if i < 4 else " ".join(words)
    passage = prose(rng, 55, kinds=10 ** 6).replace("\n", "")
    for i in range(5):
        texts[3000 + i] = prose(rng, 40) + " " + passage + " " + prose(rng, 25)
    for i in range(4):
        texts[4000 + i] = prose(rng, 30) + " " + " ".join(ITEM.split()[i:i + 10]) + " " + prose(rng, 9)
    texts |= {5000: None, 5001: "", 5002: "one"}
    return [(i, t, "en", "s", None if t is None else len(t), "x", 1, "y", "z", "w", "v") for i, t in texts.items()], passage


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    """The tables' folder, and each stage's rows by id."""
    path = str(tmp_path_factory.mktemp("pipeline"))
    planted, passage = _planted()
    planted.append(planted[5])  # a repeated row
    spark.createDataFrame(planted, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, int(1000 <= r[0] < 2000)) for r in planted if r[0] % 5 or r[0] < 100]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([("b1", ITEM), ("b2", None), ("b3", "never seen anywhere at all")], "item_id string, text string") \
        .write.parquet(f"{path}/benchmark.parquet")
    now, out = spark.read.parquet(f"{path}/documents.parquet"), [planted]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        made = stage(spark, now, path)
        if k < 4:
            assert made.dtypes == now.dtypes
        made.write.parquet(f"{path}/{k}")
        now = spark.read.parquet(f"{path}/{k}")
        out.append(now.collect())
    return out, passage


def _bag(table):
    return sorted((tuple(r) for r in table), key=str)


def test_toxic_documents_go(run):
    (before, after, *_), _ = run
    assert _bag(after) == _bag(r for r in before if "vilescum" not in (r[1] or ""))


def _shingles(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_one_document_of_a_group_stays(run):
    (_, before, after, *_), _ = run
    sets = {r[0]: _shingles(r[1]) for r in before}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
                a, b = sorted((top(x), top(y)))
                root[b] = a
    want = {i for i in ids if top(i) == i}
    assert sorted(r[0] for r in after) == sorted(want)
    assert {2000, 2001, 2002, 2003} & want == set() and len(ids) - len(want) >= 6
    kept = {r[0]: tuple(r) for r in before}
    assert all(tuple(r) == kept[r[0]] for r in after)


def test_repeated_passages_are_cut(run):
    (_, _, before, after, *_), passage = run
    n = corpus_pipeline.PASSAGE_BYTES
    starts = Counter()
    for r in before:
        b = (r[1] or "").encode()
        starts.update(b[i:i + n] for i in range(len(b) - n + 1))
    want = []
    for r in before:
        b = (r[1] or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - n + 1):
            if starts[b[i:i + n]] > 1:
                gone[i:i + n] = [True] * n
        text = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore") if any(gone) else r[1]
        want.append((r[0], text, *tuple(r)[2:4], len(text) if any(gone) else r[4], *tuple(r)[5:]))
    assert _bag(after) == _bag(want)
    assert len(passage.split()) == 55 and not any(passage in (r[1] or "") for r in after)
    changed = {r[0] for r in before} - {r[0] for r in before if tuple(r) in set(map(tuple, after))}
    assert changed == {3000, 3001, 3002, 3003, 3004}


def test_benchmark_passages_go(run):
    (_, _, _, before, after, _), _ = run
    item = ITEM.split()
    windows = {" ".join(item[i:i + 10]) for i in range(len(item) - 9)}

    def hit(text):
        words = [w.decode() for w in re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").lower().encode())]
        return any(" ".join(words[i:i + 10]) in windows for i in range(len(words)))

    assert _bag(after) == _bag(r for r in before if not hit(r[1]))
    assert len(before) - len(after) == 4


def test_all_that_is_left_is_packed(run):
    (*_, before, after), _ = run
    t = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    want = Counter({r[0]: len(t.encode(r[1] or "", add_special_tokens=False).ids) + 1 for r in before})
    got, places = Counter(), defaultdict(list)
    for r in after:
        got[r.doc_id] += r.length
        places[r.sequence_id].append((r.offset, r.length))
    assert got == want and all(sum(n for _, n in x) <= 2048 for x in places.values())
    assert len(places) <= 1.05 * sum(want.values()) / 2048 + 1


def test_empty_tables(spark, none, tmp_path):  # noqa: F811
    path = str(tmp_path)
    none.write.parquet(f"{path}/documents.parquet")
    none.select("doc_id", F.lit(1).alias("quality"), F.lit(1).alias("toxic")).write.parquet(f"{path}/labels.parquet")
    none.select(F.col("text").alias("item_id"), "text").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_clashing_columns_keep_their_values(spark):
    names = ["k", "a", "b", "kept", "id", "doc", "_k", "_a", "_b", "_kept", "rep", "row", "n_words", "hit_spans", "item_ids"]
    some = [(i, "same words here again and again " * (1 + i // 3), *[f"{n}{i}" for n in names]) for i in range(6)]
    table = spark.createDataFrame(some, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    kept = corpus_pipeline.drop_near_copies(spark, table, "")
    rows_ = kept.collect()
    assert kept.columns == table.columns and 1 <= len(rows_) < 6
    assert all(tuple(r) in set(some) for r in rows_)
    cut = corpus_pipeline.cut_repeats(spark, table, "")
    assert cut.columns == table.columns
    assert sorted((r.doc_id, *tuple(r)[2:]) for r in cut.collect()) == [(i, *x) for i, _, *x in some]


def test_registered():
    assert E.queries()["pipeline"] is corpus_pipeline.run
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "n-gram Jaccard join", "suffix-array dedup",
                                                      "benchmark decontamination", "best-fit packing"]
    names = [n for n in E.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
