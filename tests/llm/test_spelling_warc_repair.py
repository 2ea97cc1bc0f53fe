"""Spelling variants, archives and their index, conversation repair: against brute force, round trips, odd rows."""

import base64
import gzip
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import pytest
from pyarrow import fs
from pyspark.sql import functions as F

from sieveline.llm import conversation_repair, spelling, warc
from sieveline.llm.common import folder
from sieveline.llm.conversation_repair import damaged, repair
from sieveline.llm.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"



@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_warc_merge", "op13_conversation_repair"])
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got, want = QUERIES[name](spark, DATA).toArrow(), con.execute(ORACLE_SQL[name]).to_arrow_table()
    assert got.num_rows and sorted(got.column_names) == sorted(want.column_names)
    key = lambda t: sorted((tuple(str(r[c]) for c in sorted(r)) for r in t.to_pylist()))
    assert key(got) == key(want)


# --- Spelling variants ----------------------------------------------------------------------------------------------


def words_by_force(rows):
    n = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = max(a, b, key=len), min(a, b, key=len)
    return any(a[:p] + a[p + 1 :] == b for p in range(len(a)))


def variants_by_force(n):
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    best = {w: min(c, key=lambda x: (-n[x], x), default=None) for w, c in near.items()}
    form = {w: b if b and n[b] >= 10 * n[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n}


def by_word(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize(("most", "step"), [(1024, 1 << 21), (6, 40)])
def test_variants_equal_brute_force(spark, most, step):
    """Words of one syllable set, so that grams are hot: blocks of six words are cut to the last letter."""
    rnd = random.Random(4)
    base = ["".join(rnd.choice(["an", "na", "é", "tt", "a"]) for _ in range(rnd.randrange(3, 7))) for _ in range(60)]
    vocabulary = {}
    for w in base:
        for _ in range(6):
            p = rnd.randrange(len(w) + 1)
            v = rnd.choice([w, w[:p] + w[p + 1 :], w[:p] + rnd.choice("abné") + w[p:], w[:p] + rnd.choice("an") + w[p + 1 :]])
            if v:
                vocabulary[v] = rnd.choice([2, 3, 20, 30, 300, 5000])
    want = variants_by_force(vocabulary)
    near = spelling.near_words(spark.createDataFrame(list(vocabulary.items()), "word string, n long"), most, step)
    got = {r.word: r for r in near.collect()}
    assert {w: v[3] for w, v in want.items() if v[3]} == {w: r.n_near for w, r in got.items()}
    assert {w: v[0] for w, v in want.items() if v[0]} == {w: r.best for w, r in got.items() if r.best_n >= 10 * vocabulary[w]}
    assert any(v[0] != v[1] for v in want.values() if v[0])


def test_variants_of_texts(spark):
    """Chains of forms, ties, letters that aren't lower-cased, null ids and texts, repeated rows, clashing columns."""
    text = " ".join(["kitchen"] * 400 + ["kitchens"] * 30 + ["kitchensy"] * 2 + ["Ünterwegs", "ünterwegs", "ünterwegs", "Ünterwegs"] + ["balance"] * 40 + ["balancd"] * 2 + ["balanca"] * 40 + ["short"] * 9)
    rows = [(1, text, "a"), (1, text, "a"), (None, "KITCHEN kitchin kitchin", "b"), (2, None, None), (3, "", "c"), (4, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 4999 + "y " + "x" * 4999 + "y", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string")
    want = variants_by_force(words_by_force([r[:2] for r in rows]))
    got = by_word(spelling.variants(docs))
    assert got == want
    assert got["kitchensy"][:2] == ("kitchens", "kitchen") and got["balancd"][0] == "balanca"
    assert spelling.variants(docs.filter("false")).count() == 0


def test_blocks_are_bounded(spark):
    """A gram that most words share is cut: no block is larger than the bound, though 3,000 words begin alike."""
    letters = "abcdefghijklmnopqrst"
    rows = [("common" + "".join(w), 2) for w in itertools.islice(itertools.product(letters, repeat=3), 3000)]
    dealt = spelling.blocks(spark.createDataFrame(rows, "word string, n long"), 200)
    assert dealt.groupBy("key").count().agg(F.max("count")).first()[0] <= 200


# --- Archives -------------------------------------------------------------------------------------------------------


def test_archives_round_trip(spark):
    """Few records a file and a run, few entries a range: many runs are merged in many ranges."""
    rnd = random.Random(3)
    rows = [(i, f"http://{'www.' * rnd.randrange(2)}{rnd.choice('abc')}.example.com/{rnd.randrange(4)}", rnd.choice(["same", "", None, f"page {i}\r\n\r\nWARC/1.1 é"])) for i in range(300)]
    rows += [(7, "http://hot.example.com/", f"v{i}") for i in range(150)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    path = folder(spark, "archives", made=True)
    runs = warc.write_archives(pages, path, run_rows=9)
    for r in runs.groupBy("run").agg(F.sort_array(F.collect_list(F.struct("seq", "url_key", "time"))).alias("rows"), F.count("*").alias("n")).collect():
        assert r.n <= 9 and [x[1:] for x in r.rows] == sorted(x[1:] for x in r.rows)
    merged = warc.merge_runs(runs, range_rows=20)
    order = [(r.url_key, r.time, r.page_id) for r in merged.orderBy("place").collect()]
    assert [r.place for r in merged.orderBy("place").collect()] == list(range(len(rows)))
    assert order == sorted(order)
    assert Counter((k, int(i)) for k, _, i in order) == Counter((warc.url_key(u), i) for i, u, _ in rows)
    first = {}
    for i, _, h in rows:
        first[h or ""] = min(i, first.get(h or "", i))
    got = warc.read_archives(merged, keep_payload=True).collect()
    want = Counter((str(i), u, len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", None, (h or "").encode()) if first[h or ""] == i else ("revisit", str(first[h or ""]), b""))) for i, u, h in rows)
    assert Counter((r.page_id, r.url, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, bytes(r.payload)) for r in got) == want
    # Any reader of the format finds the records: members of gzip, lengths as their heads say.
    files, at = fs.FileSystem.from_uri(path)
    kinds = Counter()
    for info in files.get_file_info(fs.FileSelector(at)):
        raw = gzip.decompress(files.open_input_file(info.path).read())
        while raw:
            head, _, rest = raw.partition(b"\r\n\r\n")
            size = int(re.search(rb"Content-Length: (\d+)$", head).group(1))
            kinds[re.search(rb"WARC-Type: (\w+)", head).group(1).decode()] += 1
            assert head.startswith(b"WARC/1.1\r\n") and rest[size : size + 4] == b"\r\n\r\n"
            raw = rest[size + 4 :]
    assert kinds["response"] + kinds["revisit"] == len(rows) and kinds["warcinfo"] == runs.select("run").distinct().count()


def test_archives_of_odd_rows(spark):
    rows = [(1, "http://www.A.com:80/X?b#f", "same", 0), (None, "u v\n", "same", 0), (3, None, "same", 0), (3, "http://b.a.com", "same", 0), (None, "z", "zz", 0), (None, "z", "zz", 0), (4, "w", "l" * 3_000_000, 0)]
    pages = spark.createDataFrame(rows, "page_id int, url string, html string, place int")
    got = warc.archived(pages, keep_payload=True)
    assert dict(got.dtypes)["page_id"] == dict(got.dtypes)["refers_to"] == "int"
    rows = sorted((r.page_id or -1, r.record_type, r.refers_to or -1, r.payload_bytes) for r in got.collect())
    assert rows == [(-1, "response", -1, 2), (-1, "response", -1, 2), (-1, "revisit", 1, 4), (1, "response", -1, 4), (3, "revisit", 1, 4), (3, "revisit", 1, 4), (4, "response", -1, 3_000_000)]
    assert warc.archived(pages.filter("false")).count() == 0
    few = warc.archived(pages, least_bytes=3)
    assert few.filter("payload_bytes = 2 and record_type = 'revisit'").count() == 0
    assert warc.url_key("HTTP://user@WWW2.A.Com:80/X/y?B=1#frag") == "com,a)/x/y?b=1" and warc.url_key("") == ")/"


def test_a_changed_archive_is_an_error(spark):
    path = folder(spark, "archives", made=True)
    captures = warc.merge_runs(warc.write_archives(spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string"), path))
    with pytest.raises(Exception, match="not the record of the index"):
        warc.read_archives(captures.withColumn("digest", F.lit("A" * 32))).collect()


@pytest.mark.parametrize("k", range(9))
def test_loser_tree(k):
    rnd = random.Random(k)
    runs = [sorted(rnd.randrange(25) for _ in range(rnd.randrange(15))) for _ in range(k)]
    got = list(warc.LoserTree(runs))
    assert [runs[a][b] for a, b in got] == sorted(itertools.chain(*runs))
    assert got == sorted(got, key=lambda x: (runs[x[0]][x[1]], x[0]))  # equal keys in the order of the runs


# --- Conversation repair --------------------------------------------------------------------------------------------


def repair_by_force(rows):
    """(cost, audit, repaired text) by search over whole edit strings: cheapest first, then ASCII-least."""
    seen, faults, kinds = set(), Counter(), []
    for role, text in rows:
        bare = text.rstrip(" \t\n\x0b\x0c\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        faults[fault] += 1
        kinds.append(fault)
    best = {(0, ""): (0, "", [])}  # (rows used up, initials written) -> the best so far
    for i in range(len(rows) + 1):
        for _ in range(3):  # insertions
            for (at, out), (cost, audit, made) in list(best.items()):
                if at == i:
                    for role in ("user", "assistant"):
                        key, new = (at, out + role[0]), (cost + 3, audit + "I", [*made, f"{role}:"])
                        if re.fullmatch("s?(ua)*u?", key[1]) and (key not in best or new[:2] < best[key][:2]):
                            best[key] = new
        if i < len(rows):
            role, text = rows[i]
            for (at, out), (cost, audit, made) in list(best.items()):
                if at != i:
                    continue
                moves = [("D", 4, out, made)]
                if kinds[i] in (None, "truncated"):
                    more = 3 * (kinds[i] == "truncated")
                    moves.append(("K", more, out + (role[:1] or "?"), [*made, f"{role}:{text}"]))
                    moves += [("R", 3 + more, out + r[0], [*made, f"{r}:{text}"]) for r in ("user", "assistant")]
                for edit, more, to, written in moves:
                    key, new = (i + 1, to), (cost + more, audit + edit, written)
                    if re.fullmatch("s?(ua)*u?", to) and (key not in best or new[:2] < best[key][:2]):
                        best[key] = new
    done = [v for (at, out), v in best.items() if at == len(rows) and re.fullmatch("(s?(ua)+)?", out)]
    cost, audit, made = min(done, key=lambda v: v[:2])
    return faults["blank"], faults["duplicate"], faults["truncated"], cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest()


@pytest.mark.parametrize("piece_rows", [4096, 2])
def test_repair_equals_search(spark, piece_rows):
    rnd = random.Random(11)
    roles, texts = ["user", "assistant", "system", "user", "assistant", "tool", "", "ufo"], ["Yes.", "No", "so!", "", " \t", "cut off", "é?"]
    rows = [(c, t, rnd.choice(roles), rnd.choice(texts)) for c in range(150) for t in range(rnd.randrange(1, 8))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("gone", F.lit(False)).repartition(3)
    got = {r.conv_id: (r.blank, r.duplicate, r.truncated, r.cost, r.audit, r.repaired_sha256) for r in repair(df, piece_rows).collect()}
    by = defaultdict(list)
    for c, _, role, text in rows:
        by[c].append((role, text))
    assert got == {c: repair_by_force(v) for c, v in by.items()}


def test_repair_of_one_hot_conversation(spark):
    """Nearly all rows are of one conversation, in pieces of 50: the same as in one piece, and no group holds them."""
    rnd = random.Random(5)
    rows = [(c if c < 5 else 99, t, rnd.choice(["user", "assistant"]), rnd.choice(["a.", "b?", "", f"{t}", f"{t}."])) for t, c in enumerate([*range(5)] * 3 + [99] * 1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("gone", F.lit(False))
    cut, whole = (sorted(map(tuple, repair(df, n).collect())) for n in (50, 1 << 20))
    assert cut == whole and len(cut) == 6
    assert len(cut[-1][7]) >= 1500


def test_repair_of_odd_rows(spark):
    """Nulls everywhere, equal rows, ties of turns, a very long text, all rows gone, gaps, clashing columns, an empty table."""
    rows = [(None, 1, "user", "a."), (None, None, None, None), (1, None, "user", "q?"), (1, None, "assistant", "x" * 2_000_000 + "."), (2, 5, "user", "q?"), (2, 5, "user", "q?"), (2, 9, "assistant", "a!")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("audit", F.lit(1))
    got = {r.conv_id: r for r in repair(df.withColumn("gone", F.col("conv_id") == 7)).collect()}
    assert len(got) == 3
    assert (got[1].gaps, got[1].cost, got[1].audit) == (0, 6, "IKKI")  # role sorts before text, so the assistant comes first
    assert (got[2].gaps, got[2].duplicate, got[2].audit, got[2].illegal) == (3, 1, "KDK", 1)
    nothing = repair(df.withColumn("gone", F.lit(True))).collect()
    assert len(nothing) == 3 and {tuple(r)[1:] for r in nothing} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert repair(damaged(df.filter("false"))).count() == 0
    assert repair(damaged(df)).count() == 3


def test_damage_follows_the_hash(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"Text {t}. Really?! ok") for c in range(30) for t in range(6)] + [(None, None, None, None)]
    got = Counter((r.conv_id, r.turn, r.role, r.text) for r in damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).filter("not gone").collect())
    want = Counter()
    for c, t, role, text in rows:
        fate = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if fate:
            want[c, t, "user" if fate == 4 else role, "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text] += 1 + (fate == 3)
    assert got == want


def test_the_table_is_small():
    """Lazily made: nine kinds of rows, and few vectors, whatever is read."""
    auto, rnd = conversation_repair.Automaton(), random.Random(1)
    for _ in range(300):
        auto.behind(bytes(rnd.randrange(9) for _ in range(50)), conversation_repair.END)
    assert len(auto.vectors) < 200
