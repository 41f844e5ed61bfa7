import re

from llm_fixtures import docs, none, rows  # noqa: F401
from wardrank.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(t):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return WORD.findall(low)


def _brute(text, items, width=10):
    w = _words(text)
    hit, found = [False] * len(w), set()
    for item, t in items:
        words = _words(t)
        windows = [words[i:i + width] for i in range(max(1, len(words) - width + 1))] if words else []
        for win in windows:
            for i in range(len(w) - len(win) + 1):
                if w[i:i + len(win)] == win:
                    hit[i:i + len(win)] = [True] * len(win)
                    found.add(item)
    return len(w), sum(hit), sorted(found)


def _items(rows):
    plain = [r[1] for r in rows if r[1] and len(r[1]) > 300]
    return [("10", plain[0][:150]), ("9", " ".join(plain[1].split()[5:25]).upper()), ("7", "three"), ("7", "one, two"),
            ("8", "nowhere to be found anywhere in all of these texts at all"), ("5", None), ("6", ""), (None, "null id one two"),
            ("4", "shti " * 14), ("3", " ".join(plain[2].split()[:9])), ("2", " ".join(plain[2].split()[3:15]) + " other"), ("1", "ab")]


def test_equals_brute_force(spark, docs, rows):
    items = _items(rows)
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = sorted(((r[0] is None, r[0] or 0, *_brute(r[1], [(i or "", t) for i, t in items])) for r in rows), key=repr)
    for block in (1_000_000, 30):  # one block and many
        out = decontam.find_contamination(docs, bench, block_words=block)
        got = out.select("doc_id", "n_words", decontam.hit_words().alias("h"), "item_ids").collect()
        assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_words, r.h, r.item_ids) for r in got), key=repr) == want
    assert any(x[3] for x in want)


def test_empty_tables(spark, docs, none, rows):
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert decontam.find_contamination(docs, nothing).where("size(hit_spans) > 0").count() == 0
    assert decontam.find_contamination(docs, nothing).count() == len(rows)
    assert decontam.find_contamination(none, nothing).count() == 0
