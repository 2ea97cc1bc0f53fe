"""BPE, chat formatting, personal data, passages: against brute force on small tables."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sieveline.llm import bpe, minhash_dedup, pii_crf, suffix_dedup
from sieveline.llm.queries import op1_pii_crf, op4_byte_bpe
from sieveline.llm.chat_format import chat_examples, conversation_digest, read_turns

RANKS = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def odd_texts(n, seed=1):
    rnd = random.Random(seed)
    signs = list("abcdefghijklmnopqrstuvwxyzABC éüñß日本語русский\n\t  0123456789!?#'’sSt\x1c　\U0001f600")
    return ["".join(rnd.choice(signs) for _ in range(rnd.randint(0, 60))) for _ in range(n)]


def test_encoding_equals_the_library():
    encoder = bpe.Encoder(RANKS, public_tokenizers.PATTERN)
    rnd = random.Random(2)
    texts = [*odd_texts(2000), "a" * 3000, " " * 500, "the" * 1000, "\n" * 300, "", "".join(rnd.choice("etaoinshr") for _ in range(20000))]
    for _ in range(2):  # the second time transitions are there
        ids, ends = encoder.encode(texts)
        for i, t in enumerate(texts):
            assert ids[ends[i] : ends[i + 1]].tolist() == LIBRARY.encode_ordinary(t)


def test_transducer_equals_the_merges_and_forgets():
    fst = bpe.Transducer(RANKS, max_states=50)
    rnd = random.Random(3)
    for _ in range(500):
        piece = "".join(rnd.choice("aeinrstüé") for _ in range(rnd.randint(1, 14))).encode()
        assert fst.encode(piece) == ([RANKS[piece]] if piece in RANKS else bpe.merge(RANKS, piece))
    assert len(fst._sets) < 200
    for flush in (1, 8, 256):  # what is written early is what is written at the end
        fst = bpe.Transducer(RANKS, flush=flush)
        for sign in ("ab", "etaoinshr", "aé日", " \n"):
            piece = "".join(rnd.choice(sign) for _ in range(3000)).encode()
            assert fst.encode(piece) == LIBRARY._encode_single_piece(piece)
    with pytest.raises(ValueError, match="lacks a byte"):
        bpe.Transducer({b"a": 0}).encode(b"ab")


def test_bpe_query_equals_the_library(spark):
    documents = "/root/testdata/sf0.01/documents.parquet"
    got = {r.doc_id: r for r in op4_byte_bpe(spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet(documents).select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for r in rows:
        ids = LIBRARY.encode_ordinary(r.text or "")
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids_sha256, got[r.doc_id].decoded_sha256) == want


def test_decoded_bytes_are_those_of_the_ids(spark):
    ids = [RANKS[bytes([b])] for b in (0xE6, 0x97, 0x41, 0xFF)]
    docs = spark.createDataFrame([(1, ids), (2, None)], "doc_id long, ids array<int>")
    assert [bytes(r.decoded) for r in bpe.bpe_decode(docs, RANKS, raw=True).orderBy("doc_id").collect()] == [b"\xe6\x97A\xff", b""]
    assert [r.decoded for r in bpe.bpe_decode(docs, RANKS).orderBy("doc_id").collect()] == ["�A�", ""]


def test_streaming_decode_splits_code_points():
    stream = bpe.Utf8Stream()
    data = "é日\U0001f600".encode()
    out = [stream.feed(data[i : i + 1]) for i in range(len(data))]
    assert "".join(out) + stream.close() == "é日\U0001f600"
    assert stream.feed(b"\xff") + stream.close() == "�"
    assert stream.feed(b"\xe6\x97") == "" and stream.close() == "�"
    rnd = random.Random(12)
    some = [*range(0x7E, 0x82), *range(0x8E, 0x92), *range(0x9E, 0xA2), 0xBF, 0xC0, 0xC1, 0xC2, 0xDF, 0xE0, 0xE1, 0xED, 0xEE, 0xEF, 0xF0, 0xF1, 0xF3, 0xF4, 0xF5, 0xFF, 0x41]
    for _ in range(20_000):
        data = bytes(rnd.choice(some) for _ in range(rnd.randint(0, 14)))
        cuts = sorted(rnd.randint(0, len(data)) for _ in range(rnd.randint(0, 4)))
        own = bpe.Utf8Stream()
        got = "".join(own.feed(data[a:b]) for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)) + own.close()
        assert got == data.decode("utf-8", "replace"), data


def test_bpe_on_spark(spark):
    texts = [None, "", "x" * 200_000, *odd_texts(50), "twice", "twice"]
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, IDS string")
    out = bpe.bpe_decode(bpe.bpe_encode(docs, RANKS, public_tokenizers.PATTERN), RANKS)
    rows = out.collect()
    assert sorted(bpe.bpe_round_trip(docs, RANKS, public_tokenizers.PATTERN).collect(), key=lambda r: r.doc_id) == sorted(rows, key=lambda r: r.doc_id)
    assert len(rows) == len(texts)
    for r in rows:
        assert r.decoded == (texts[r.doc_id] or "")
        assert r.ids == LIBRARY.encode_ordinary(texts[r.doc_id] or "")
    assert bpe.bpe_encode(docs.filter("false"), RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.bpe_decode(out.select("doc_id", F.lit(None).cast("array<int>").alias("ids")), RANKS).first().decoded == ""


def test_chat_round_trip(spark):
    nasty = ["\\### Assistant: </turn> ok", "&amp;lt; & <", None, "", "### x:\ny</turn>\n", "a\n\nb", "same", "same"]
    roles = ["user", "assistant", "assistant", None, "sys:tem\n#", "user", "assistant", "user"]
    turns = spark.createDataFrame([(1, i, r, t, "z") for i, (r, t) in enumerate(zip(roles, nasty, strict=True))] + [(2, 0, "user", "only", "z"), (None, None, "assistant", "n", "z")], "conv_id long, turn long, role string, text string, example string")
    examples = chat_examples(turns)
    rows = [r for r in examples.collect() if r.conv_id == 1]
    assert len(rows) == 4  # three replies, and the turns after the last one
    for r in examples.withColumn("turns", read_turns(F.col("text"))).filter("conv_id = 1").collect():
        assert [(t.role, t.text) for t in r.turns] == [(a or "", b or "") for a, b in zip(roles, nasty, strict=True)][: len(r.turns)]
    got = {r.conv_id: r for r in conversation_digest(examples).collect()}
    loss = "".join(t or "" for r, t in zip(roles, nasty, strict=True) if r == "assistant")
    assert got[1].n_turns == 8
    assert got[1].loss_chars == len(loss)
    assert got[1].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for r, t in zip(roles, nasty, strict=True)).encode()).hexdigest()
    assert (got[2].n_turns, got[2].loss_chars) == (1, 0)
    assert got[None].n_turns == 1
    assert conversation_digest(chat_examples(turns.filter("false"))).count() == 0


def plain_spans(t):
    """The patterns as the contract writes them."""
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(d)))
        if 16 <= len(d) <= 19 and total % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_patterns_equal_the_plain_ones():
    rnd = random.Random(4)
    for _ in range(8000):
        t = "".join(rnd.choice("ab.@-+ 0123456789()%é") for _ in range(rnd.randint(0, 60)))
        assert pii_crf.pattern_spans(t) == plain_spans(t)
    assert pii_crf.pattern_spans("4111 1111 1111 1111, +1 (017) 555-7713, a.b@c.de, 10.0.0.255, 10.0.0.256") == plain_spans("4111 1111 1111 1111, +1 (017) 555-7713, a.b@c.de, 10.0.0.255, 10.0.0.256")
    assert pii_crf.pattern_spans("1" * 50_000 + "." * 50_000 + "x" * 50_000) == []


@pytest.fixture(scope="module")
def crf():
    return pii_crf.fit_crf(pii_crf.labelled_table())


def test_crf_adds_what_is_written_otherwise(crf):
    cases = {
        "write tim.o (at) mail9.example.com now": ("email", "tim.o (at) mail9.example.com"),
        "x.y22 [at] mail4 [dot] example [dot] com and": ("email", "x.y22 [at] mail4 [dot] example [dot] com"),
        "call (415) 555-2671 please": ("phone", "(415) 555-2671"),
        "seen at 10[.]1[.]2[.]3 today": ("ip", "10[.]1[.]2[.]3"),
    }
    for text, (kind, span) in cases.items():
        assert [(pii_crf.KINDS[k], text[a:b]) for k, a, b in pii_crf.crf_spans([text], crf, [[]])[0]] == [(kind, span)]
    clean = ["in 2019 (see 4) it", "on 2024-05-17 at 10:30", "4. of may, 12 of 1999", "id 9807915762804490 is no card", 'key "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "", "\n\n"]
    assert pii_crf.crf_spans(clean, crf, [[]] * len(clean)) == [[]] * len(clean)


def test_viterbi_equals_trying_all(crf):
    from itertools import product

    _, features = pii_crf.tokens("a (at) b.de")
    features = features[:5]
    e = [crf.emission(f) for f in features]
    score = lambda y: sum(e[i][v] for i, v in enumerate(y)) + crf.moves[0, y[0]] + crf.moves[y[-1], 0] + sum(crf.moves[a, b] for a, b in zip(y, y[1:], strict=False))
    best = max(product(range(len(crf.moves)), repeat=len(features)), key=score)
    assert tuple(crf.decode([np.array(e)])[0]) == best


def odd_lines(n, seed):
    rnd = random.Random(seed)
    some = ["jo", "Mail", "AT", " at ", " dot ", "(at)", "[dot]", "@", ".", " ", "  ", "\t", "(030)", "555", "-", "1234", "12345678901234", "é", "_", "+", "10", "日本", "com", ",", "the", "ß9"]
    return ["".join(rnd.choice(some) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_all_tokens_are_scored_and_what_is_settled_early_is_the_best_way(crf):
    lines = odd_lines(3000, 15)
    score, at, size = crf.scores("\n".join(lines))
    want = [pii_crf.tokens(t) for t in lines]
    flat = [crf.emission(f) for _, fs in want for f in fs]
    assert np.allclose(score[size > 0], np.array(flat))
    begins = np.cumsum([0, *(len(t) + 1 for t in lines)])
    assert at[size > 0].tolist() == [b + a for b, (spans, _) in zip(begins.tolist(), want, strict=False) for a, _ in spans]
    whole = np.concatenate(crf.decode([np.array([crf.emission(f) for f in fs]).reshape(-1, score.shape[1]) for _, fs in want]))
    runs = crf.open_runs(score, size == 0)
    got = np.zeros(len(score), np.int64)
    for (a, b), labels in zip(runs.tolist(), crf.decode([score[a:b] for a, b in runs.tolist()]), strict=True):
        got[a:b] = labels
    assert (got[size > 0] == whole).all() and whole.any()


def hidden(rnd):
    """Personal data written in unusual ways: not the lines of the labelled table."""
    name, host, top = rnd.choice(["tom", "mia", "lea.b", "ug77", "Ana"]), rnd.choice(["post3", "acme", "mail", "kontor"]), rnd.choice(["com", "org", "de", "net"])
    digits = lambda n: "".join(str(rnd.randint(0, 9)) for _ in range(n))
    return rnd.choice(
        [
            f"{name} (at) {host}.example.{top}", f"{name}[at]{host}[dot]{top}", f"{name.replace('.', ' dot ')} at {host} dot {top}", f"{name} at {host} dot example dot {top}", f"{name} @ {host}.{top}",
            f"({digits(3)}) 555-{digits(4)}", f"1-800-555-{digits(4)}", f"{rnd.randint(1, 223)}[.]{rnd.randint(0, 255)}[.]{rnd.randint(0, 255)}[.]{rnd.randint(0, 255)}",
        ]
    )


def test_hidden_data_is_found_and_prose_left_alone(spark, crf):
    """Recall and precision of what the CRF adds to whole documents."""
    rnd = random.Random(16)
    texts = [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").orderBy("doc_id").collect()]
    before = sum(map(len, pii_crf.crf_spans(texts, crf, [pii_crf.pattern_spans(t) for t in texts])))
    put = right = added = 0
    for k in range(0, len(texts), 3):
        words = texts[k].split(" ")
        at = rnd.randint(0, len(words))
        own = hidden(rnd)
        left = " ".join([*words[:at], ""])
        text = left + own + " " + " ".join(words[at:])
        found = pii_crf.crf_spans([text], crf, [pii_crf.pattern_spans(text)])[0]
        put, added = put + 1, added + len(found)
        right += any(a < len(left) + len(own) and len(left) < b for _, a, b in found)
    assert right / put >= 0.9
    assert right / added >= 0.9
    assert before <= len(texts) / 50


def test_pii_query_equals_the_plain_patterns(spark):
    got = {r.doc_id: r for r in op1_pii_crf(spark, "/root/testdata/sf0.01").collect()}
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    written = lambda spans: ",".join(f"{pii_crf.KINDS[k]}:{a}:{b}" for k, a, b in spans)
    for r in rows:
        base, own = plain_spans(r.text or ""), got[r.doc_id]
        assert [own[f"n_{k}"] for k in pii_crf.KINDS] == [sum(x == i for x, _, _ in base) for i in range(4)]
        assert own.base_sha256 == hashlib.sha256(written(base).encode()).hexdigest()
        spans = [tuple(x.split(":")) for x in own.spans.split(",") if x]
        assert spans == sorted(spans, key=lambda x: (pii_crf.KINDS.index(x[0]), int(x[1]), int(x[2])))
        assert set(filter(None, written(base).split(","))) <= set(own.spans.split(",")) and len(spans) == len(base) + own.n_added


def test_pii_on_spark(spark, crf):
    texts = [None, "", "mail a@b.co " * 3, "é a@b.co", "x" * 100_000, "9" * 200_000, "a1" * 100_000, "write to jo at mail dot com today.\n" * 2, "write to jo at mail dot com today.\n" * 2]
    docs = spark.createDataFrame([(i, t, "p") for i, t in enumerate(texts)], "doc_id long, text string, Pii string")
    got = {r.doc_id: r for r in pii_crf.find_pii(docs, crf).collect()}
    assert [len(got[i].pii) for i in range(9)] == [0, 0, 3, 1, 0, 0, 0, 2, 2]
    assert (got[3].pii[0].start, got[3].pii[0].end, got[3].pii[0].base) == (2, 8, True)
    assert pii_crf.find_pii(docs.filter("false"), crf).count() == 0


def passages_by_force(rows):
    seen, out = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        runs = int((gone & ~np.append(False, gone[:-1])).sum()) if len(b) else 0
        out[i] = (len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("limit", [20_000, 30])
def test_passages_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "STRETCHES", limit)
    rnd = random.Random(5)
    passages = ["".join(rnd.choice("abcdé fgh") for _ in range(rnd.choice([60, 99, 100, 101, 150, 300]))) for _ in range(12)]
    part = lambda: rnd.choice([rnd.choice(passages), "".join(rnd.choice("xyz uvw") for _ in range(rnd.randint(0, 120))), "a" * rnd.randint(0, 250), rnd.choice(passages)[rnd.randint(0, 20) :]])
    rows = [(k * 3, "".join(part() for _ in range(rnd.randint(0, 5)))) for k in range(250)]
    rows += [(5000, None), (5001, ""), (5002, "ab" * 400), (5003, "ab" * 700)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, Id int").repartition(5)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_passages(docs).collect()}
    assert got == passages_by_force(sorted(rows))
    assert suffix_dedup.remove_passages(docs.filter("false")).count() == 0


def test_passages_with_null_and_repeated_ids(spark):
    rnd = random.Random(6)
    text = "".join(rnd.choice("abcdefghij") for _ in range(260))
    docs = spark.createDataFrame([(None, text), (1, text), (1, text), (2, text)], "doc_id long, text string")
    got = sorted((-1 if r.id is None else r.id, r.n_removed) for r in suffix_dedup.remove_passages(docs).collect())
    assert got == [(-1, 0), (1, 260), (1, 260), (2, 260)]
    part = lambda n: "".join(rnd.choice("klmnopqrst é") for _ in range(n))
    a, b, c = part(300), part(300), part(150)
    rows = [(None, a), (None, b), (None, c + a), (None, ""), (None, None), (0, a), (7, a), (7, b + c), (7, part(300)), (7, part(300)), (8, c), (8, c), (8, "x" * 99), (8, "x" * 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    h = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], h[r[1]] if r[1] else 0))
    want = sorted(passages_by_force([(k, t) for k, (_, t) in enumerate(order)]).items())
    got = [(r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_passages(docs).collect()]
    text = lambda t: "\0" if t is None else t
    assert sorted(map(str, got)) == sorted(str((i, *w)) for (i, t), (_, w) in zip(order, want, strict=True)), text


def test_passages_of_very_long_and_very_common_texts(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LONG", 5000)
    monkeypatch.setattr(suffix_dedup, "STRETCHES", 40)
    rnd = random.Random(9)
    part = lambda n: "".join(rnd.choice("abcdefgh ij") for _ in range(n))
    common = part(130)
    rows = [(k, part(rnd.randint(0, 50)) + common + part(rnd.randint(0, 50))) for k in range(300)]
    long = part(12_000)
    rows += [(1000, long), (1001, part(30) + long[200:11_000]), (1002, long[4800:5300])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(120)
    got = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_passages(docs).collect()}
    assert got == passages_by_force(rows)


def test_equal_digests_are_not_taken_for_equal_bytes(spark, monkeypatch):
    """With a hash that says the same of everything, bytes alone decide."""
    monkeypatch.setattr(suffix_dedup.xxhash, "xxh3_64_intdigest", lambda _: 5)
    rnd = random.Random(10)
    texts = ["".join(rnd.choice("abcd") for _ in range(400)) for _ in range(3)]
    parts = [t.encode() for t in (texts[0], texts[1], texts[0][100:], texts[2])]
    rows = [b.to_pydict() for b in suffix_dedup._slice_digits(np.arange(4), np.arange(4), parts)]
    assert rows[0]["id"] == []  # nothing is taken for a copy of the first stretch, though the digests agree
    assert set(rows[1]["id"]) == {0, 1, 2, 3}


def test_any_last_label_makes_a_spoken_address():
    """No list decides which top-level names there are: what the CRF labels as an address is one."""
    model = pii_crf.fit_crf(pii_crf.labelled_table())
    for text in ("write to jo at mail dot pl today", "write to anna at firma dot se today", "write to jo at mail dot com today"):
        spans = pii_crf.crf_spans([text], model, [[]])[0]
        assert [text[a:b] for _, a, b in spans] == [text[9:-6]]


def test_memos_are_bounded_in_characters():
    """Ten thousand long words that all differ leave next to nothing behind, and change no result."""
    words = [f"{i:06d}" + "ab" * 5000 for i in range(2000)]
    shingler, shapes = minhash_dedup.Shingler(), pii_crf._Shapes({})
    for w in words:
        shingler.words(w + " short")
        shapes[w]
    assert set(shingler.memo) == {"short"} and not shapes
    assert shingler.words(words[0])[0] == minhash_dedup.Shingler().words(words[0])[0]
    small, large = (bpe.Encoder(RANKS, public_tokenizers.PATTERN, memo_chars=n) for n in (50, 1 << 30))
    texts = ["q" * 300 + f" word{i} and é" for i in range(40)] + ["", "q" * 300]
    (ids, ends), (want, want_ends) = small.encode(texts), large.encode(texts)
    assert ids.tolist() == want.tolist() and ends.tolist() == want_ends.tolist() and small.chars <= 50
