import hashlib
from collections import Counter

import pytest
from public_tokenizers import path

from tessera.llm import alignment


def brute(rows):
    """Every document's column values, from byte offsets of whole texts."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer
    from tokenizers.pre_tokenizers import ByteLevel

    a_own = Tokenizer.from_file(path(alignment.A))
    a_own.encode_special_tokens = True
    b_own = SentencePieceProcessor(model_file=path(alignment.B))
    assert len(ByteLevel.alphabet()) == 256
    plain = [c for c in range(256) if chr(c) in ByteLevel.alphabet() and c not in (173,)]
    letters = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(c for c in range(256) if c not in plain)}
    spelling = {i: bytes(letters[c] for c in t) for t, i in a_own.get_vocab().items()}

    def spell(i):
        p = b_own.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b_own.is_byte(i) else p.replace("▁", " ").encode()

    def spans(tokens):
        at, out = 0, []
        for t in tokens:
            out.append((at, at + len(t)))
            at += len(t)
        return out

    found = []
    for doc_id, text in rows:
        text = text or ""
        a, b = a_own.encode(" " + text, add_special_tokens=False).ids, b_own.encode(text)
        x, y = [spelling[i] for i in a], [spell(i) for i in b]
        whole = (" " + text).encode()
        if not text or b"".join(x) != whole or b"".join(y) != whole:
            found.append((doc_id, [], [], [], ""))
            continue
        x, y = spans(x), spans(y)
        ends = sorted({e for _, e in x} & {e for _, e in y})
        links = [(a[i], b[j]) for i, (p, q) in enumerate(x) for j, (r, s) in enumerate(y) if p < s and r < q]
        groups, low = [], 0
        for end in ends:
            groups.append(",".join(str(t) for t, (p, q) in zip(a, x) if low <= p < end) + "|" + ",".join(str(t) for t, (p, q) in zip(b, y) if low <= p < end))
            low = end
        found.append((doc_id, a, b, links, ";".join(groups)))
    count = Counter(link for _, _, _, links, _ in found for link in links)
    top = {}
    for (_, b), n in count.items():
        top[b] = max(top.get(b, 0), n)
    return sorted(
        (
            (d, len(a), len(b), len(g.split(";")) if g else 0, len(links), sum(count[k] == top[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(g.encode()).hexdigest() if g else "")
            for d, a, b, links, g in found
        ),
        key=repr,
    )


ROWS = [
    (1, "Hello world, don't  stop \n now\n"),
    (2, " leading and trailing "),
    (3, None),
    (4, ""),
    (5, " "),
    (6, "end <|endoftext|> start <s> </s> <unk> <0x41>"),
    (7, "under▁score has a mark"),
    (8, "漢字かな交じり文 emoji 😀😀 naïve \x00 \x1c x"),
    (9, "Hello world, don't  stop \n now\n"),
    (None, "the the the thesaurus 12345 67,890.12 ..."),
    (9, "a second row of nine, a b a　b   c\t d"),
    (10, "x" * 3000),
    (11, "\r\n\r\n" + "word " * 50),
    (12, "   many    blanks        " * 5),
]


def rows_of(frame):
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("most", [alignment.MOST_PAIRS, 40, 0])
def test_equal_to_byte_offsets(spark, most):
    docs = spark.createDataFrame([(d, t, 1, "x") for d, t in ROWS], "doc_id long, text string, row int, groups string")
    assert rows_of(alignment.align(docs, most=most)) == brute(ROWS)


def test_equal_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").filter("length(text) < 1500")
    assert rows_of(alignment.align(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_stretches_and_forgetting(spark, monkeypatch):
    rows = [(i, t) for i, t in ROWS if t] + [(100, "one two  three " * 40)]
    want = brute(rows)
    monkeypatch.setattr(alignment, "STRETCH", 7)
    monkeypatch.setattr(alignment, "KEPT_BYTES", 1000)
    own = alignment.Aligner(path(alignment.A), path(alignment.B))
    got = sorted([(d, *own.document(t, True)[:5]) for d, t in rows], key=repr)
    assert got == sorted([(w[0], *w[1:5], w[7]) for w in want], key=repr)


def test_groups_are_given_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "Hello world"), (2, None)], "doc_id long, text string")
    rows = {r.doc_id: r for r in alignment.align(docs, groups=True).collect()}
    assert hashlib.sha256(rows[1].groups.encode()).hexdigest() == rows[1].groups_sha256 and rows[2].groups == ""
    assert alignment.align(docs.limit(0)).count() == 0


def test_contradicting_bytes():
    machine = alignment.Transducer([b"ab", b"c", b"abc", b""], [b"a", b"bc", b"x", b"c"])
    assert machine.run([0, 1], [0, 1]) == ([2], [2], [0 << 32 | 0, 0 << 32 | 1, 1 << 32 | 1])
    assert machine.run([2], [0, 1]) == ([1], [2], [2 << 32 | 0, 2 << 32 | 1])
    assert machine.run([0, 1], [0, 2]) is None and machine.run([0], [0]) is None and machine.run([1], [3, 3]) is None
