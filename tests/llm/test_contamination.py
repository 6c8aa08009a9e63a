import hashlib
import re
import sys
from pathlib import Path

import pytest

from tessera.llm import contamination as c

sys.path.insert(0, str(Path(__file__).parent))
from helpers import same_as_sql  # noqa: E402

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = "one two three four five six seven eight nine ten eleven twelve"
ITEMS = [(1, LONG), (2, "Ünïcode, dash"), (10, "three four five SIX seven eight nine ten eleven twelve"), (3, ""), (4, None), (5, "..., !!"), (1, "solo"), (None, "no id here"), (7, LONG)]
DOCS = [
    (1, "zero ONE,two;three four-five six seven eight nine ten... and more"),
    (2, "x " + LONG + " y " + LONG),
    (3, None),
    (4, ""),
    (5, "one two three four five six seven eight nine"),
    (6, "a SOLO b Ünïcode dash Ünïcode\n\ndash"),
    (7, "Ünïcode dash"),
    (8, "there is no id here"),
    (8, "solo"),
    (None, "solo solo"),
    (9, "one two three four five six seven eight nine"),
    (10, "ten eleven twelve"),
    (11, " ".join([LONG] * 30)),
    (12, "\x00solo\x7fsolo`solo"),
]


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(docs, items, width):
    windows = {}
    for i, t in items:
        w = WORD.findall(lowered(t))
        for k in range(max(1, len(w) - width + 1)) if w else []:
            windows.setdefault(tuple(w[k : k + width]), set()).add(i)
    out = []
    for d, t in docs:
        w = WORD.findall(lowered(t))
        hit, found = set(), set()
        for n in range(1, width + 1):
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        listed = ",".join(sorted(str(i) for i in found if i is not None))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(listed.encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def frames(spark):
    return spark.createDataFrame([(*d, 1, "s") for d in DOCS], "doc_id long, text string, row int, spans string"), spark.createDataFrame([(*i, 2) for i in ITEMS], "item_id long, text string, round int")


@pytest.mark.parametrize("width,most", [(10, c.MOST_WINDOWS), (10, 60), (3, c.MOST_WINDOWS), (3, 25), (1, 1 << 20)])
def test_equal_to_brute_force(spark, width, most):
    docs, items = frames(spark)
    got = sorted((tuple(r) for r in c.contamination(docs, items, width, most).collect()), key=repr)
    assert got == brute(DOCS, ITEMS, width)


def test_equal_to_sql(spark):
    same_as_sql(c.op12_contamination, c.OP12_SQL, spark, "/root/testdata/sf0.001")


def test_spans_and_documents_are_removed(spark):
    docs, items = frames(spark)
    hit = {(r[0], r[1]) for r in brute(DOCS, ITEMS, 10) if r[5]}
    cut = c.decontaminate(docs, items)
    assert cut.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in cut.collect()), key=repr)
    want = dict.fromkeys(DOCS)
    texts = {d: [t for e, t in got if e == d] for d, _ in got}
    assert len(got) == len(want) and texts[1] == ["zero ... and more"] and texts[2] == ["x  y "] and texts[6] == ["a  b "] and texts[3] == [None] and texts[5] == [DOCS[4][1]] and texts[12] == ["\x00"]
    assert all(row[5] is False for row in brute(got, ITEMS, 10) if row[0] in (1, 2, 6, 7, 11, 12))
    kept = c.decontaminate(docs, items, drop=True)
    assert kept.columns == docs.columns and kept.count() == sum(not r[5] for r in brute(DOCS, ITEMS, 10)) and len(hit)


def test_no_items_and_no_rows(spark):
    docs, items = frames(spark)
    assert not c.contamination(docs, items.limit(0)).filter("contaminated").count()
    assert c.contamination(docs.limit(0), items).count() == 0 and c.decontaminate(docs.limit(0), items).count() == 0
    assert c.decontaminate(docs, items.limit(0)).count() == len(DOCS)


def test_equal_hashes_are_told_apart_by_words(spark, monkeypatch):
    docs, items = frames(spark)
    monkeypatch.setattr(c.words, "mix", lambda x, seed=0: x & c.np.uint64(0))
    known = c.Windows(10, items.toArrow())
    raw = [(t or "").encode() for _, t in DOCS]
    offsets = c.np.cumsum([0, *map(len, raw)])
    found = c.Words(c.np.frombuffer(b"".join(raw), c.np.uint8), offsets)
    first, width, window = c.hits(found, known)
    got = [set() for _ in DOCS]
    for f, w, k in zip(first.tolist(), width.tolist(), window.tolist()):
        got[found.row[f]] |= set(known.items[k])
    assert [len(x) for x in got] == [brute([d], ITEMS, 10)[0][3] for d in DOCS]
