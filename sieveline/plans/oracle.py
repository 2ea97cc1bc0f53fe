"""DuckDB equivalents of the queries."""

from __future__ import annotations

from ..functions import fixed
from ..functions.scoring import LONG, SHORT, Additive
from ..operators.evaluate import POISSON

SQL: dict[str, str] = {}


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def arr(values) -> str:
    return "[" + ", ".join(lit(v) if isinstance(v, str) else str(v) for v in values) + "]"


def any_of(text: str, parts) -> str:
    return "(" + " OR ".join(f"contains({text}, {lit(p)})" for p in parts) + ")"


def count_of(text: str, parts) -> str:
    return "(" + " + ".join(f"contains({text}, {lit(p)})::INT" for p in parts) + ")"


def cases(pairs, otherwise) -> str:
    return "CASE " + " ".join(f"WHEN {a} THEN {b}::DOUBLE" for a, b in pairs) + f" ELSE {otherwise}::DOUBLE END"


BLANK = r"[\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x0b]"
STRIPPED = rf"regexp_replace(content, '^{BLANK}+|{BLANK}+$', '', 'g')"


def stripped(text: str) -> str:
    return STRIPPED.replace("(content,", f"({text},")


def abstract(text: str = "content", delimiter: str = ".") -> str:
    return f"substr({stripped(f'split_part({text}, {lit(delimiter)}, 1)')}, 1, 400)"


OVERVIEW = "substr(array_to_string(string_split(content, chr(10))[1:5], chr(10)), 1, 8000)"
MEM = f"""mem AS (SELECT doc_id AS id, coalesce(text, '') AS content, lang, source, {arr(LONG.categories)}[doc_id % 9 + 1] AS category,
  ['code', 'knowledge', 'event', 'conversation', 'noise'][doc_id % 5 + 1] AS type,
  CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS person, doc_id % 2 = 0 AS has_metadata FROM documents)"""
ITEMS = "items AS (SELECT item_id AS query_id, text FROM benchmark)"
VEC = "vec AS (SELECT vec_id AS doc_id, embedding::DOUBLE[] AS v, label FROM embeddings), asked AS (SELECT doc_id // 100 AS query_id, doc_id AS own, v, label FROM vec WHERE doc_id % 100 = 0)"
WORDS = r"regexp_extract_all(lower({t}), '[\p{{L}}\p{{N}}_]+')"
CHARS = r"list_filter(string_split(replace(regexp_replace({t}, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), ' ', ''), ''), lambda x: x <> '')"


def bm25(tokens: str, items: str = "items") -> str:
    """CTEs up to scored(query_id, doc_id, score)."""
    return f"""
tok AS (SELECT id AS doc_id, {tokens.format(t="l")} AS ts FROM (SELECT id, {abstract()} || ' ' || {OVERVIEW} AS l FROM mem)),
post AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS term FROM tok) GROUP BY ALL),
stat AS (SELECT count(*) AS n, avg(len(ts)) AS avgdl FROM tok),
raw AS (SELECT term, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, stat GROUP BY term, n),
idf AS (SELECT term, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
qt AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest({tokens.format(t="text")}) AS term FROM {items}) GROUP BY ALL),
scored AS (SELECT query_id, doc_id, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(ts) / avgdl))) AS score
  FROM qt JOIN idf USING (term) JOIN post USING (term) JOIN tok USING (doc_id), stat GROUP BY query_id, doc_id)"""


WORD_BM25 = f"{MEM}, {ITEMS}, {bm25(WORDS)}"


def top(rows: str, k: int | None, cols: str = "query_id, doc_id, score") -> str:
    q = f"SELECT {cols}, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM {rows}"
    return q if k is None else f"SELECT * FROM ({q}) WHERE rank <= {k}"


LEX = f"lex AS ({top('(SELECT * FROM scored WHERE score > 0)', 50)})"
COSINE = "list_dot_product(q.v, d.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(d.v, d.v)))"
L2 = "-list_distance(q.v, d.v)"


def near(score: str, k: int | None, self: bool) -> str:
    where = "" if self else "WHERE q.own <> d.doc_id"
    return top(f"(SELECT query_id, doc_id, {score} AS score FROM asked q CROSS JOIN vec d {where})", k)


NEAR = f"near AS ({near(COSINE, 50, False)})"
BOTH = f"WITH {WORD_BM25}, {LEX}, {VEC}, {NEAR}"
RANKED = "SELECT query_id, doc_id, round(score, 6) + 0.0::DOUBLE AS score, rank FROM"


def entities() -> str:
    return " + ".join(f"len(regexp_extract_all(content, {lit(p)}))" for p in (r"https?://\S+", r"\S+@\S+", r"`[^`]+`", "[0-9]+"))


def additive(edition: Additive) -> tuple[str, dict[str, str]]:
    n, low, bare = "length(content)", "lower(content)", STRIPPED
    density = f"(({entities()}) / greatest({n} / 100.0, 1.0))"
    hedges = count_of(low, edition.hedges)
    opens = "(" + " OR ".join(f"regexp_matches({bare}, {lit('(?i)' + p)})" for p in edition.openings) + ")"
    dims = {
        "type": cases([(any_of(low, parts), s) for s, parts in edition.types], 0.7),
        "length": cases([*[(f"{n} < {c}", s) for c, s in edition.lengths], (f"{n} BETWEEN 200 AND 2000", 1.0), (f"{n} > 5000", 0.5)], 0.8),
        "entity": cases([(f"{density} > 5", 1.0), (f"{density} > 2", 0.8)], 0.6),
        "destructive": cases([(f"{hedges} = 0", 1.0), (f"{hedges} <= 2", edition.hedge_scores[0])], edition.hedge_scores[1]),
        "template": cases([(opens, edition.opening_score)], 1.0),
        "metadata": cases([(f"category = {lit(k)}", v) for k, v in edition.categories.items()], 1.0),
    }
    total = " + ".join(f"({c}) * {w}::DOUBLE" for c, w in zip(dims.values(), edition.weights, strict=True))
    if edition.short_circuits:
        greet = ", ".join(map(lit, fixed.GREETINGS))
        tests = [
            (f"({bare} IN ({greet}) OR regexp_replace({bare}, '[.!]+$', '') IN ({greet}))", 0.3, 0.1),
            (f"(length({bare}) <= 5 AND regexp_matches({bare}, '^[{fixed.FILLERS}]*$'))", 0.2, 0.2),
            (f"(length({bare}) >= 3 AND regexp_matches({bare}, '^[{fixed.DOTS}]+$'))", 0.25, 0.3),
            (f"(length({bare}) >= 3 AND len(list_distinct(string_split({bare}, ''))) = 1)", 0.2, 0.2),
        ]
        some = " OR ".join(t for t, _, _ in tests)
        silent = {"type": 0.7, "entity": 0.6, "destructive": 1.0, "template": 0.2, "metadata": 1.0}
        total = f"CASE WHEN {some} THEN {cases([(t, s) for t, s, _ in tests], 0)} ELSE {total} END"
        dims = {k: f"CASE WHEN {some} THEN {cases([(t, x) for t, _, x in tests], 0) if k == 'length' else silent[k]} ELSE {c} END" for k, c in dims.items()}
    return total, dims


LONG_SQL, SHORT_SQL = additive(LONG)[0], additive(SHORT)[0]
STOP_SHARE = "length(regexp_replace({own}, '[^{chars}]', '', 'g')) / nullif(length({own}), 0)"
OWN = r"regexp_replace(content, '[ \n\t]', '', 'g')"


def multiplied() -> str:
    n = "length(content)"
    ents = f"(len(regexp_extract_all(content, '[A-Z][a-z]+')) + {count_of('content', fixed.ENTITY_WORDS)})"
    share = f"coalesce({STOP_SHARE.format(own=OWN, chars=fixed.STOP_CHARS)}, 0)"
    parts = [
        cases([(f"type = {lit(k)}", v) for k, v in fixed.TYPE_FACTOR.items()], 1),
        cases([(f"{n} < 10", 0.5), (f"{n} < 20", 0.8), (f"{n} > 100", 1.1)], 1),
        cases([(f"{ents} >= 2", 1.2), (f"{ents} = 0", 0.8)], 1),
        cases([(f"{share} > 0.5", 0.7)], 1),
        cases([(any_of("content", fixed.TEMPLATE_PARTS), 0.6)], 1),
        cases([("has_metadata", 1.1)], 1),
    ]
    return "least(1.0::DOUBLE, greatest(0.0::DOUBLE, " + " * ".join(f"({p})" for p in parts) + "))"


MULT = f"mult AS (SELECT *, {multiplied()} AS quality FROM mem)"
FEATURES = {
    "type": cases([(f"type = {lit(k)}", v) for k, v in fixed.TYPE_FACTOR.items()], 1),
    "length": cases([("length(content) < 10", 0.5), ("length(content) < 20", 0.8), ("length(content) > 100", 1.1)], 1),
    "entity": cases([("length(person) > 0", 1.2)], 0.8),
    "stopwords": cases([(f"length(regexp_replace(content, '[^{fixed.STOP_CHARS_LEARNER}]', '', 'g')) / greatest(length(content), 1) > 0.5", 0.7)], 1),
    "template": cases([(any_of("content", fixed.TEMPLATE_PARTS_LEARNER), 0.6)], 1),
    "metadata": cases([("has_metadata", 1.1)], 1),
}


def noise(min_tokens: int, ratio: float) -> str:
    chars = "list_filter(string_split(replace(content, ' ', ''), ''), lambda x: x <> '')"
    words = f"list_filter(regexp_split_to_array(lower(content), '{BLANK}+'), lambda x: x <> '')"
    every = f"({chars} || {words})"
    stops = arr([*fixed.STOP_CHARS, *fixed.STOP_WORDS])
    share = f"len(list_filter({every}, lambda x: list_contains({stops}, x))) / nullif(len({every}), 0)"
    return f"((len({chars}) < {min_tokens} AND len({words}) < {min_tokens}) OR len({every}) = 0 OR coalesce({share}, 0) > {ratio} OR {any_of('content', fixed.PLACEHOLDERS)})"


# --- Search -----------------------------------------------------------------------------------------------------------

SQL["search_bm25_quality"] = f"""WITH {MEM}, {ITEMS}, {bm25(WORDS)},
best AS ({top("(SELECT * FROM scored WHERE score > 0)", 20)}),
q AS (SELECT id AS doc_id, {SHORT_SQL} AS quality FROM mem),
w AS (SELECT query_id, doc_id, score * (0.5 + 0.5 * quality) AS score, quality FROM best JOIN q USING (doc_id) WHERE quality >= 0.3)
SELECT query_id, doc_id, round(score, 6) AS score, round(quality, 6) AS quality, rank FROM ({top("w", 5, "query_id, doc_id, score, quality")})"""
SQL["bm25_word_top50"] = f"WITH {WORD_BM25}, {LEX} {RANKED} lex"
SQL["bm25_block_max"] = SQL["bm25_word_top50"]
TURNED = MEM.replace("coalesce(text, '') AS content", "CASE WHEN doc_id % 16 = 0 THEN array_to_string(list_reverse(string_split(coalesce(text, ''), chr(10))), chr(10)) ELSE coalesce(text, '') END AS content").replace(
    "FROM documents)", "FROM documents WHERE doc_id % 11 > 0 AND doc_id % 13 > 0)")
SQL["bm25_segments"] = f"WITH {TURNED}, {ITEMS}, {bm25(WORDS)} {top('(SELECT * FROM scored WHERE score > 0)', 20)}"
SQL["index_vocabulary"] = f"WITH {TURNED}, {ITEMS}, {bm25(WORDS)} SELECT term, count(*) AS df, n, avgdl FROM post, stat GROUP BY term, n, avgdl"
SQL["bm25_char_top20"] = f"WITH {MEM}, {ITEMS}, {bm25(CHARS)} {RANKED} ({top('(SELECT * FROM scored WHERE score > 0)', 20)})"
SQL["cosine_topk"] = f"WITH {VEC}, {NEAR} {RANKED} near"
SQL["ivf_topk"] = f"WITH {VEC} {RANKED} ({near(COSINE, 10, True)})"
SQL["vector_index_topk"] = SQL["ivf_topk"]
SQL["dot_topk"] = f"WITH {VEC} {RANKED} ({near('list_dot_product(q.v, d.v)', 10, True)})"
SQL["l2_topk"] = f"WITH {VEC} {RANKED} ({near(L2, 10, True)})"


def rrf(first: int, a: str = "lex", b: str = "near") -> str:
    return f"(SELECT query_id, doc_id, sum(1.0::DOUBLE / (60 + rank + {first - 1})) AS score FROM (SELECT query_id, doc_id, rank FROM {a} UNION ALL SELECT query_id, doc_id, rank FROM {b}) GROUP BY query_id, doc_id)"


SQL["rrf_one_based"] = f"{BOTH} {RANKED} ({top(rrf(1), 20)})"
SQL["rrf_zero_based"] = f"{BOTH} {RANKED} ({top(rrf(0), 20)})"
SQL["rrf_or_vector"] = f"""{BOTH}, has AS (SELECT DISTINCT query_id FROM lex),
u AS (SELECT * FROM {rrf(0, "(SELECT * FROM near WHERE query_id IN (SELECT query_id FROM has))", "lex")}
  UNION ALL SELECT query_id, doc_id, score FROM near WHERE query_id NOT IN (SELECT query_id FROM has))
{RANKED} ({top("u", 10)})"""
WITH_VECTOR = MEM.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL))")
SQL["rrf_weighted_full"] = f"""WITH {VEC}, {WITH_VECTOR}, {ITEMS}, {bm25(WORDS)},
grid AS (SELECT q.query_id, d.doc_id, list_dot_product(q.v, d.v) AS sv, round(coalesce(s.score, 0), 9) AS sl
  FROM asked q CROSS JOIN vec d JOIN mem ON mem.id = d.doc_id LEFT JOIN scored s ON s.query_id = q.query_id AND s.doc_id = d.doc_id),
placed AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY round(sv, 9) DESC, doc_id) AS rv, row_number() OVER (PARTITION BY query_id ORDER BY sl DESC, doc_id) AS rl FROM grid),
w AS (SELECT query_id, doc_id, 0.7::DOUBLE / (60 + rv) + 0.3::DOUBLE / (60 + rl) AS score FROM placed)
SELECT query_id, doc_id, round(round(score, 12) + 1e-10::DOUBLE, 6) AS score, rank FROM ({top("w", 10)})"""


def blend(alpha: float) -> str:
    return f"(SELECT query_id, doc_id, sum(score) AS score FROM (SELECT query_id, doc_id, {alpha}::DOUBLE * score AS score FROM near UNION ALL SELECT query_id, doc_id, {round(1 - alpha, 9)}::DOUBLE * score FROM lex) GROUP BY query_id, doc_id)"


SQL["linear_blend"] = f"{BOTH} {RANKED} ({top(blend(0.6), 10)})"
SQL["hybrid_search"] = f"{BOTH}, fused AS ({top(rrf(1), 20)}) {RANKED} ({top('fused', 10)}) WHERE rank <= 5"
SQL["hybrid_search_quality"] = f"""{BOTH}, fused AS ({top(rrf(1), 20)}), q AS (SELECT id AS doc_id, {LONG_SQL} AS quality FROM mem),
w AS (SELECT query_id, doc_id, score * (0.5 + 0.5 * quality) AS score FROM fused JOIN q USING (doc_id) WHERE rank <= 10 AND quality >= 0.85)
{RANKED} ({top("w", 5)})"""
SQL["rerank_embedding_quality"] = f"""WITH {VEC}, {NEAR}, {MEM}, {MULT},
w AS (SELECT n.query_id, n.doc_id, n.score * coalesce(m.quality, 0.5) AS score, round(coalesce(m.quality, 0.5), 6) AS quality
  FROM near n LEFT JOIN mult m ON m.id = n.doc_id WHERE rank <= 20)
SELECT query_id, doc_id, round(score, 6) AS score, quality, rank FROM ({top("w", 10, "query_id, doc_id, score, quality")})"""
BLANKS = f"list_distinct(list_filter(regexp_split_to_array(lower({{t}}), '{BLANK}+'), lambda x: x <> ''))"


def overlap(q: str, d: str) -> str:
    a, b = BLANKS.replace("{t}", q), BLANKS.replace("{t}", d)
    return f"len(list_intersect({a}, {b})) / greatest(len({a}), 1)"


SQL["rerank_lexical"] = f"""WITH {WORD_BM25}, {LEX},
w AS (SELECT query_id, doc_id, {overlap("i.text", "substr(m.content, 1, 1000)")} AS score FROM lex JOIN items i USING (query_id) JOIN mem m ON m.id = doc_id WHERE rank <= 20)
{RANKED} ({top("w", 10)})"""
SPLIT = f"list_distinct(list_filter(regexp_split_to_array({{t}}, '{BLANK}+'), lambda x: x <> ''))"
SHARED = f"len(list_intersect({SPLIT.replace('{t}', 'i.text')}, {SPLIT.replace('{t}', 'substr(m.content, 1, 500)')})) / greatest(len({SPLIT.replace('{t}', 'i.text')}), 1)"
SQL["rerank_plugin"] = f"""WITH {WORD_BM25}, {LEX},
w AS (SELECT query_id, doc_id, {SHARED} AS score FROM lex JOIN items i USING (query_id) JOIN mem m ON m.id = doc_id WHERE rank <= 20)
{RANKED} ({top("w", 10)})"""
SQL["judged_retrieval"] = f"""WITH {WORD_BM25}, {LEX},
f AS (SELECT query_id, list(substr(content, 1, 1000)) AS found FROM lex JOIN mem m ON m.id = doc_id WHERE rank <= 5 GROUP BY query_id),
e AS (SELECT query_id, list_filter(string_split(text, ' '), lambda w: length(w) >= 6)[1:3] AS want FROM items),
h AS (SELECT query_id, len(want) AS n, len(list_filter(want, lambda w: len(list_filter(coalesce(found, []), lambda t: contains(t, w))) > 0)) AS hits FROM e LEFT JOIN f USING (query_id))
SELECT query_id, CASE WHEN n > 0 AND hits = n THEN '是' WHEN hits > 0 THEN '部分' ELSE '否' END || ' ' || (100 * hits // greatest(n, 1)) || ' 分' AS reply,
       CASE WHEN n > 0 AND hits = n OR 100 * hits // greatest(n, 1) >= 80 THEN 'success' WHEN hits > 0 OR 100 * hits // greatest(n, 1) >= 50 THEN 'partial' ELSE 'fail' END AS verdict FROM h"""
SQL["rerank_cross_quality"] = f"""WITH {WORD_BM25}, {LEX}, {MULT},
x AS (SELECT query_id, doc_id, {SHARED} AS score FROM lex JOIN items i USING (query_id) JOIN mem m ON m.id = doc_id),
b AS ({top("x", 30)}), w AS (SELECT query_id, doc_id, score * quality AS score, quality FROM b JOIN mult ON id = doc_id)
SELECT query_id, doc_id, round(score, 6) AS score, round(quality, 6) AS quality, rank FROM ({top("w", 10, "query_id, doc_id, score, quality")})"""
SQL["rerank_none"] = f"WITH {WORD_BM25}, {LEX} {RANKED} lex WHERE rank <= 10"
SQL["formatted_results"] = f"WITH {WORD_BM25}, {LEX} SELECT query_id, id, md5({OVERVIEW}) AS content, round(score, 6) AS score, length({OVERVIEW}) // 4 AS tokens, category FROM lex JOIN mem ON id = doc_id WHERE rank <= 5"
SQL["rerank_listwise"] = f"""WITH {WORD_BM25}, {LEX},
o AS (SELECT query_id, unnest([query_id % 5, 3, 1]) AS pos, unnest([0, 1, 2]) AS place FROM items),
f AS (SELECT query_id, pos, min(place) AS place FROM o GROUP BY ALL),
w AS (SELECT l.query_id, l.doc_id, -place::DOUBLE AS score FROM lex l JOIN f ON f.query_id = l.query_id AND f.pos = l.rank - 1 WHERE rank <= 20)
{RANKED} ({top("w", 10)})"""
SQL["intent_routing"] = f"""WITH {ITEMS}, t AS (SELECT query_id, lower(['preference', 'skill of a project', 'Project memory', 'history', ''][query_id % 5 + 1] || ' ' || text) AS low FROM items),
r AS (SELECT query_id, list_filter([{", ".join(f"CASE WHEN {any_of('low', parts)} THEN {lit(path)} END" for path, parts in fixed.ROUTES)}], lambda x: x IS NOT NULL) AS dirs FROM t),
d AS (SELECT query_id, CASE WHEN len(dirs) = 0 THEN ['/agent/memories'] ELSE dirs END AS dirs FROM r)
SELECT query_id, unnest(range(len(dirs))) AS place, unnest(dirs) AS path FROM d"""
SQL["keyword_overlap"] = f"""WITH {MEM}, {ITEMS},
own AS (SELECT id AS doc_id, '/' || category AS path, {BLANKS.replace("{t}", OVERVIEW)} AS ws FROM mem),
q AS (SELECT query_id, {BLANKS.replace("{t}", "'memory skill ' || text")} AS ws, lower('memory skill ' || text) AS low FROM items),
r AS (SELECT query_id, ws, unnest(list_filter([{", ".join(f"CASE WHEN {any_of('low', parts)} THEN {lit(path)} END" for path, parts in fixed.ROUTES)}], lambda x: x IS NOT NULL)) AS path,
  unnest(range(len(list_filter([{", ".join(f"CASE WHEN {any_of('low', parts)} THEN {lit(path)} END" for path, parts in fixed.ROUTES)}], lambda x: x IS NOT NULL)))) AS pos FROM q),
s AS (SELECT query_id, doc_id, r.path, pos, len(list_intersect(r.ws, own.ws)) / greatest(len(r.ws), 1) AS raw FROM r JOIN own USING (path))
SELECT * FROM (SELECT query_id, doc_id, path, round(raw, 3) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 3) DESC, pos, doc_id) AS rank FROM s WHERE raw > 0.05) WHERE rank <= 10"""
SQL["substring_search"] = f"WITH {MEM} SELECT id, CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END AS preview FROM mem WHERE contains(lower(content), 'that') ORDER BY id LIMIT 20"
SQL["like_search"] = f"WITH {MEM} SELECT id, 0.5::DOUBLE AS score FROM mem WHERE contains(content, 'tion') ORDER BY id LIMIT 20"

# --- Text and layers --------------------------------------------------------------------------------------------------

SQL["layers"] = f"WITH {MEM}, l AS (SELECT id, {abstract()} AS a, {OVERVIEW} AS o, content, {abstract(delimiter='。')} AS b FROM mem) SELECT id, sha256(a) AS l0, sha256(o) AS l1, sha256(content) AS l2, length(a) AS n0, length(o) AS n1, sha256(b) AS l0_base FROM l"
SQL["layer_selected"] = f"WITH {MEM} SELECT id, md5(CASE id % 3 WHEN 0 THEN {abstract()} WHEN 1 THEN {OVERVIEW} ELSE content END) AS md5 FROM mem"
TOKENS = f"tk AS (SELECT *, length({abstract()}) AS n0, length({OVERVIEW}) AS n1, length(content) AS n2 FROM mem)"
SQL["token_stats"] = f"WITH {MEM}, {TOKENS} SELECT id, n0 // 4 AS l0, n1 // 4 AS l1, n2 // 4 AS l2, (n0 + n1 + n2) // 4 AS total FROM tk"
RAW = "list_filter(string_split(replace(content, ' ', ''), ''), lambda x: x <> '')"
BLANK_ALL = f"list_filter(regexp_split_to_array(lower(content), '{BLANK}+'), lambda x: x <> '')"
SQL["tokenizers"] = f"WITH {MEM} SELECT id, " + ", ".join(f"len({e}) AS {k}, md5(coalesce(array_to_string({e}, '|'), '')) AS {k}_md5" for k, e in (("words", WORDS.format(t="content")), ("chars", CHARS.format(t="content")), ("raw_chars", RAW), ("blanks", BLANK_ALL))) + " FROM mem"
SQL["previews"] = f"WITH {MEM} SELECT id, CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END AS preview FROM mem"
SQL["compress"] = f"WITH {MEM} SELECT id, id % 4 <> 0 AS done, true AS compressed, md5(CASE WHEN id % 4 <> 0 THEN substr(content, 1, 400) ELSE {abstract()} END) AS l0, md5(CASE WHEN id % 4 <> 0 THEN substr(content, 1, 8000) ELSE {OVERVIEW} END) AS l1 FROM mem"
SQL["text_features"] = f"WITH {MEM} SELECT id, " + ", ".join(f"len(regexp_extract_all(content, {lit(p)})) AS {k}" for k, p in (("urls", r"https?://\S+"), ("emails", r"\S+@\S+"), ("code", r"`[^`]+`"), ("numbers", "[0-9]+"), ("capitalised", "[A-Z][a-z]+"))) + f", {count_of('content', fixed.ENTITY_WORDS)}::BIGINT AS entity_words, round({STOP_SHARE.format(own=OWN.replace('content', 'lower(content)'), chars='etaoin')}, 6) AS share FROM mem"
SQL["parsers"] = """WITH r AS (SELECT item_id, item_id % 13 AS s, item_id % 2 = 0 AS even, item_id * 7 % 100 AS p, item_id % 4 AS v, item_id % 3 = 0 AS none, item_id % 8 AS o FROM benchmark)
SELECT item_id, least(1.0, CASE WHEN even THEN s::DOUBLE ELSE s + 0.25::DOUBLE END) AS score,
  CASE WHEN v = 0 OR p >= 80 THEN 'success' WHEN v = 1 OR p >= 50 THEN 'partial' ELSE 'fail' END AS verdict,
  CASE WHEN none THEN '0,1,2,3,4' WHEN o < 5 THEN '2,' || o || ',0' ELSE '2,0' END AS "order" FROM r"""
SQL["store_stats"] = f"""WITH {MEM}, {TOKENS}, q AS (SELECT *, {LONG_SQL} AS q FROM tk)
SELECT count(*) AS total_memories, sum(n0 // 4)::BIGINT AS l0_tokens, sum(n1 // 4)::BIGINT AS l1_tokens, sum(n2 // 4)::BIGINT AS l2_tokens,
  round(avg(q), 6) AS avg_quality, count(*) FILTER (q >= 0.7) AS high_quality, count(*) FILTER (q < 0.4) AS low_quality,
  round(1 - sum(n0 // 4) / sum(n2 // 4), 6) AS l0_savings, round(1 - sum(n1 // 4) / sum(n2 // 4), 6) AS l1_savings, sum(n2 // 4)::BIGINT AS total_tokens FROM q"""
SQL["store_stats_all"] = f"""WITH {MEM}, {TOKENS}, s AS (SELECT count(*) AS c, sum(n0 // 4)::BIGINT AS a, sum(n1 // 4)::BIGINT AS b, sum(n2 // 4)::BIGINT AS d FROM tk)
SELECT c AS total_memories, a AS l0_tokens, b AS l1_tokens, d AS l2_tokens, round(1 - a / (a + b + d), 6) AS l0_savings, round(1 - b / (a + b + d), 6) AS l1_savings, a + b + d AS total_tokens FROM s"""
SQL["type_distribution"] = f"""WITH {MEM}, t AS (SELECT type AS value, count(*) AS n FROM mem GROUP BY ALL ORDER BY n DESC, value LIMIT 5),
p AS (SELECT person AS value, count(*) AS n FROM mem WHERE person <> '' GROUP BY ALL ORDER BY n DESC, value LIMIT 5)
SELECT value, n, round(n / (SELECT count(*) FROM mem), 6) AS share, 'type' AS what FROM t
UNION ALL SELECT value, n, round(n / (SELECT count(*) FROM mem WHERE person <> ''), 6), 'person' FROM p"""

# --- Quality and noise ------------------------------------------------------------------------------------------------

for name, edition in (("quality_additive_pro", LONG), ("quality_additive_full", SHORT)):
    total, dims = additive(edition)
    SQL[name] = f"WITH {MEM} SELECT id, round({total}, 6) AS quality, " + ", ".join(f"({c})::DOUBLE AS d_{k}" for k, c in dims.items()) + " FROM mem"
SQL["quality_stub"] = f"WITH {MEM} SELECT CASE WHEN {STRIPPED} IN ('你好', 'hi', 'hello') THEN 0.3::DOUBLE ELSE 0.7::DOUBLE END AS quality, count(*) AS n FROM mem GROUP BY ALL"
SQL["quality_multiplicative"] = f"WITH {MEM}, {MULT} SELECT id, round(quality, 6) AS quality FROM mult"
SQL["quality_by_type"] = f"WITH {MEM}, {MULT} SELECT type, count(*) AS n, round(avg(quality), 6) AS mean, round(min(quality), 6) AS least, round(max(quality), 6) AS most, round(stddev_pop(quality), 6) AS std FROM mult GROUP BY type"
SQL["quality_bands"] = f"WITH {MEM}, q AS (SELECT round({LONG_SQL}, 6) AS q FROM mem) SELECT CASE WHEN q >= 0.93 THEN 'high' WHEN q < 0.9 THEN 'low' ELSE 'medium' END AS band, count(*) AS n FROM q GROUP BY ALL"
SQL["quality_predict"] = f"WITH {MEM} SELECT id, round(least(1.0, greatest(0.0, " + " * ".join(f"({w} * {FEATURES[k]})" for k, w in zip(FEATURES, (0.9, 0.95, 1.0, 1.0, 1.0, 1.0), strict=True)) + ")), 6) AS quality FROM mem"
SQL["threshold_retention"] = f"WITH {MEM}, {MULT} SELECT count(*) AS total, count(*) FILTER (quality >= 0.5) AS retained, round(count(*) FILTER (quality >= 0.5) / count(*), 6) AS rate FROM mult"
SQL["cleanup_noise"] = f"WITH {MEM} SELECT category, count(*) AS kept FROM mem WHERE {LONG_SQL} >= 0.9 GROUP BY category"
SQL["noise_flags"] = f"WITH {MEM} SELECT id, {noise(5, 0.8)} AS noise, {noise(60, 0.05)} AS noise_strict FROM mem"
SQL["noise_ratio"] = f"WITH {MEM}, n AS (SELECT {noise(5, 0.8)} AS noise FROM mem) SELECT count(*) AS total, count(*) FILTER (noise) AS noisy, round(avg(noise::INT), 6) AS ratio FROM n"
ACCURACY = f"acc AS (SELECT count(*) AS n, avg(((({LONG_SQL}) < 0.9) = (l.quality = 0))::INT) AS accuracy FROM mem JOIN labels l ON l.doc_id = id)"
SQL["noise_accuracy"] = f"WITH {MEM}, {ACCURACY} SELECT n, round(accuracy, 6) AS accuracy FROM acc"

SQL["noise_examples"] = f"WITH {MEM} SELECT id, CASE WHEN length(content) > 100 THEN substr(content, 1, 100) || '...' ELSE content END AS preview FROM mem WHERE {noise(60, 0.05)} ORDER BY id LIMIT 10"
SQL["percentages"] = f"WITH {MEM}, {MULT} SELECT type, printf('%.1f%%', floor(avg((quality >= 0.9)::INT) * 100)) AS kept FROM mult GROUP BY type"
SQL["scored_jsonl"] = f"WITH {MEM}, {MULT} SELECT id, type, md5(content) AS content, round(quality, 6) AS quality_score FROM mult"
SQL["embedding_cache"] = "SELECT md5(vec_id::VARCHAR) AS key, len(embedding) AS dim, round(list_sum(embedding::DOUBLE[]), 6) + 0.0::DOUBLE AS total FROM embeddings"
SQL["dataset_conversion"] = "SELECT 'small' AS scale, count(*) AS memories FROM documents"
SQL["batch_insert"] = f"WITH {MEM} SELECT id, category, len(embedding) AS dim FROM mem JOIN embeddings ON vec_id = id"

# --- Evaluation -------------------------------------------------------------------------------------------------------

LABEL_RELS = "rel AS (SELECT query_id, doc_id FROM asked JOIN vec USING (label) WHERE own <> doc_id)"


def report(ranking: str, ks: tuple[int, ...] = (1, 5, 10)) -> str:
    rates = ", ".join(f"avg((coalesce(hit, 1000000) <= {k})::INT) AS recall_{k}" for k in ks)
    return f"(SELECT count(*) AS queries, {rates}, avg(CASE WHEN hit <= 10 THEN 1.0::DOUBLE / hit ELSE 0 END) AS mrr FROM (SELECT DISTINCT query_id FROM rel) LEFT JOIN (SELECT query_id, min(rank) AS hit FROM {ranking} JOIN rel USING (query_id, doc_id) GROUP BY query_id) USING (query_id))"


ITEM_RELS = "rel AS (SELECT i.query_id, m.id AS doc_id FROM items i JOIN mem m ON contains(m.content, substr(i.text, 1, 60)))"
WORD_TEN = f"{MEM}, {ITEMS}, {bm25(WORDS)}, ten AS ({top('(SELECT * FROM scored WHERE score > 0)', 10)}), {ITEM_RELS}, rep AS (SELECT * FROM {report('ten')})"
ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in ("recall_1", "recall_5", "recall_10", "mrr"))
SQL["recall_mrr"] = f"WITH {WORD_TEN} SELECT queries, {ROUNDED} FROM rep"
GAIN = "list_sum([1.0::DOUBLE / log2(i + 1) FOR i IN range(1, least(n, {k})::BIGINT + 1)])"
SQL["precision_ndcg"] = f"""WITH {VEC}, near AS ({near(COSINE, 10, False)}), {LABEL_RELS},
n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY ALL),
h AS (SELECT query_id, min(rank) AS hit, {", ".join(f"count(*) FILTER (rank <= {k}) AS h{k}" for k in (1, 5, 10))},
  {", ".join(f"sum(1.0::DOUBLE / log2(rank + 1)) FILTER (rank <= {k}) AS d{k}" for k in (5, 10))} FROM near JOIN rel USING (query_id, doc_id) GROUP BY ALL),
j AS (SELECT * FROM n LEFT JOIN h USING (query_id))
SELECT count(*) AS queries, {", ".join(f"round(avg((coalesce(h{k}, 0) > 0)::INT), 6) AS hit_rate_{k}, round(avg(coalesce(h{k}, 0) / n), 6) AS recall_{k}" for k in (1, 5, 10))},
  {", ".join(f"round(avg(coalesce(h{k}, 0) / {k}), 6) AS precision_{k}, round(avg(coalesce(d{k}, 0) / {GAIN.format(k=k)}), 6) AS ndcg_{k}" for k in (5, 10))},
  round(avg(CASE WHEN hit <= 10 THEN 1.0::DOUBLE / hit ELSE 0 END), 6) AS mrr FROM j"""
SQL["ab_quality_delta"] = f"""WITH {VEC}, {NEAR}, {MEM}, {MULT}, {LABEL_RELS},
w AS (SELECT query_id, doc_id, score * coalesce(quality, 0.5) AS score FROM near LEFT JOIN mult ON id = doc_id), better AS ({top("w", 10)}),
a AS (SELECT * FROM {report("near")}), b AS (SELECT * FROM {report("better")})
SELECT m AS metric, round(x, 6) AS a, round(y, 6) AS b, round((y - x) * 100, 6) AS delta FROM (
  {" UNION ALL ".join(f"SELECT '{m}' AS m, a.{m} AS x, b.{m} AS y FROM a, b" for m in ("recall_1", "recall_5", "recall_10", "mrr"))})"""
METRICS = ("recall_1", "recall_5", "recall_10", "mrr")
GAINS = lambda c: [*[f"(coalesce({c}, 1000000) <= {k})::INT::DOUBLE" for k in (1, 5, 10)], f"CASE WHEN {c} <= 10 THEN 1.0::DOUBLE / {c} ELSE 0 END"]
SQL["ab_quality_interval"] = f"""WITH {VEC}, {NEAR}, {MEM}, {MULT}, {LABEL_RELS},
w AS (SELECT query_id, doc_id, score * coalesce(quality, 0.5) AS score FROM near LEFT JOIN mult ON id = doc_id), better AS ({top("w", 10)}),
ha AS (SELECT query_id, min(rank) AS a FROM near JOIN rel USING (query_id, doc_id) GROUP BY ALL), hb AS (SELECT query_id, min(rank) AS b FROM better JOIN rel USING (query_id, doc_id) GROUP BY ALL),
d AS (SELECT query_id, {", ".join(f"{y} - {x} AS {m}" for m, x, y in zip(METRICS, GAINS("a"), GAINS("b"), strict=True))} FROM (SELECT DISTINCT query_id FROM rel) LEFT JOIN ha USING (query_id) LEFT JOIN hb USING (query_id)),
l AS (SELECT *, ('0x' || substr(md5('1:' || query_id || ':' || lane), 1, 13))::BIGINT / pow(16, 13) AS u FROM (SELECT *, unnest(range(200)) AS lane FROM d)),
v AS (SELECT *, {" + ".join(f"(u >= {p})::INT" for p in POISSON)} AS times FROM l),
s AS (SELECT lane, {", ".join(f"CASE WHEN sum(times) > 0 THEN 100 * sum(times * {m}) / sum(times) ELSE 0 END AS {m}" for m in METRICS)} FROM v GROUP BY lane)
{" UNION ALL ".join(f"SELECT '{m}' AS metric, round((SELECT 100 * avg({m}) FROM d), 6) AS delta, round(list_sort(list({m}))[6], 6) AS low, round(list_sort(list({m}))[195], 6) AS high FROM s" for m in METRICS)}"""
SQL["alpha_sweep"] = f"""{BOTH}, {LABEL_RELS}, {", ".join(f"r{i} AS ({top(blend(a), 10)}), p{i} AS (SELECT {a}::DOUBLE AS parameter, recall_5 AS value FROM {report(f'r{i}')})" for i, a in enumerate((0.0, 0.5, 1.0)))},
u AS (SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2)
SELECT parameter, round(value, 6) AS value, row_number() OVER (ORDER BY round(value, 9) DESC, parameter) = 1 AS best FROM u"""
PAIRS = f"pairs AS (SELECT q.doc_id AS a, d.doc_id AS b, {COSINE} AS similarity FROM vec q JOIN vec d ON q.doc_id < d.doc_id WHERE {COSINE} > 0.4)"
SQL["near_duplicates"] = f"WITH {VEC}, {PAIRS} SELECT a, b, round(similarity, 6) AS similarity FROM pairs"
SQL["duplicate_classes"] = f"""WITH RECURSIVE {VEC}, {PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
r AS (SELECT a AS id, a AS seen FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.seen)
SELECT v.doc_id AS id, (SELECT count(*) FROM e WHERE e.a = v.doc_id) AS n_links, coalesce((SELECT min(seen) FROM r WHERE r.id = v.doc_id), v.doc_id) AS class_id FROM vec v"""
SQL["duplicate_ratio"] = f"WITH {VEC}, {PAIRS}, i AS (SELECT a AS id FROM pairs UNION SELECT b FROM pairs) SELECT (SELECT count(*) FROM i) AS duplicates, (SELECT count(*) FROM vec) AS total, (SELECT count(*) FROM pairs) AS pairs, round((SELECT count(*) FROM i) / (SELECT count(*) FROM vec), 6) AS ratio"
SQL["duplicate_samples"] = f"""WITH {VEC}, {PAIRS}, {MEM}, s AS (SELECT * FROM pairs ORDER BY a, b LIMIT 20)
SELECT a, b, round(similarity, 6) AS similarity, substr(x.content, 1, 100) AS text_a, substr(y.content, 1, 100) AS text_b FROM s LEFT JOIN mem x ON x.id = a LEFT JOIN mem y ON y.id = b"""
RUNS = {"vector": "(SELECT * FROM near WHERE rank <= 10)", "bm25": "(SELECT * FROM lex WHERE rank <= 10)", "hybrid": f"({top(blend(0.5), 10)})"}
SQL["benchmark_runs"] = f"{BOTH}, {ITEM_RELS} " + " UNION ALL ".join(
    f"SELECT queries, {ROUNDED}, '{kind}' AS retrieval_type, 0.5::DOUBLE AS alpha, 10::BIGINT AS k, (SELECT count(*) FROM mem) AS corpus_size, (SELECT count(*) FROM items) AS query_size FROM {report(rows)}" for kind, rows in RUNS.items()
)
KEPT = MEM.replace("FROM documents)", "FROM documents WHERE doc_id % 7 <> 0)")
SQL["bm25_incremental"] = f"WITH {KEPT}, {ITEMS}, {bm25(CHARS)} {RANKED} ({top('(SELECT * FROM scored WHERE score > 0)', 20)})"
SQL["embedding_drift"] = """WITH o AS (SELECT embedding::DOUBLE[] AS v, row_number() OVER (ORDER BY vec_id) <= (SELECT count(*) // 2 FROM embeddings) AS old FROM embeddings),
e AS (SELECT old, unnest(v) AS x, unnest(range(len(v))) AS i FROM o),
c AS (SELECT i, avg(x) AS c, avg(x) FILTER (old) AS a, avg(x) FILTER (NOT old) AS b FROM e GROUP BY i),
k AS (SELECT sqrt(sum(c * c)) AS n, sqrt(sum((a - b) * (a - b))) AS s, sum(a * b) / (sqrt(sum(a * a)) * sqrt(sum(b * b))) AS cs FROM c),
m AS (SELECT count(*) AS t, avg(sqrt(list_dot_product(v, v))) AS mn, stddev_pop(sqrt(list_dot_product(v, v))) AS sn FROM o),
f AS (SELECT avg(x) FILTER (NOT old) - avg(x) FILTER (old) AS mc, var_pop(x) FILTER (NOT old) - var_pop(x) FILTER (old) AS vc FROM e)
SELECT t AS total, round(mn, 6) AS mean_norm, round(sn, 6) AS std_norm, round(n, 6) AS centroid_norm, round(s, 6) AS centroid_shift, round(cs, 6) AS centroid_cosine,
  round(mc, 6) + 0.0::DOUBLE AS mean_change, round(vc, 6) + 0.0::DOUBLE AS variance_change, CASE WHEN cs < 0.95 THEN 'HIGH' WHEN cs < 0.98 THEN 'MODERATE' ELSE 'LOW' END AS level FROM k, m, f"""
SQL["text_match"] = f"""WITH {WORD_BM25}, {LEX}, got AS (SELECT query_id, rank, md5(content) AS t FROM lex JOIN mem ON id = doc_id WHERE rank <= 10),
want AS (SELECT DISTINCT query_id, lower(t) AS t FROM (SELECT query_id, t FROM got WHERE rank IN (2, 5) UNION ALL SELECT query_id, text FROM items)),
g AS (SELECT query_id, lower(t) AS t, min(rank) AS rank FROM got GROUP BY ALL),
e AS (SELECT query_id, avg((rank IS NOT NULL)::INT) AS recall, min(rank) AS first FROM want LEFT JOIN g USING (query_id, t) GROUP BY query_id)
SELECT count(*) AS queries, round(avg(recall), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr FROM e"""
SQL["category_rollup"] = f"WITH {MEM}, s AS (SELECT category, id * 7 % 100 AS s FROM mem) SELECT category, count(*) AS total, count(*) FILTER (s >= 80) AS success, count(*) FILTER (s >= 50 AND s < 80) AS partial, round((count(*) FILTER (s >= 80) + 0.5 * count(*) FILTER (s >= 50 AND s < 80)) / count(*), 6) AS rate FROM s GROUP BY category"
SQL["combined_score"] = f"WITH {WORD_TEN}, {ACCURACY}, c AS (SELECT (round(recall_1, 6) * 100 + round(accuracy, 6) * 100) / 2 AS s FROM rep, acc) SELECT round(s, 6) AS score, CASE WHEN s >= 80 THEN 'good' WHEN s >= 60 THEN 'fair' ELSE 'poor' END AS band FROM c"

# --- Labels -----------------------------------------------------------------------------------------------------------

PAIRS_OF = f"""c AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
r AS (SELECT *, last_value(CASE WHEN role = 'assistant' AND turn >= 1 THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS reply FROM c),
u AS (SELECT *, list_filter(string_split(reply, chr(10))[1:10], lambda x: length(x) > 30 AND length(x) < 300)[1:5] AS good FROM r
  WHERE role = 'user' AND text <> '' AND NOT starts_with(text, '<') AND NOT starts_with(text, 'System:') AND reply IS NOT NULL AND contains(lower(reply), 'the')),
p AS (SELECT conv_id, turn, substr(text, 1, 200) AS query, unnest(range(len(good))) AS place, {stripped("unnest(good)")} AS memory FROM u)"""
SQL["query_memory_pairs"] = f"WITH {PAIRS_OF} SELECT conv_id, turn, place, md5(query) AS query, md5(memory) AS memory FROM p"
SQL["user_queries"] = "SELECT conv_id, turn, md5(substr(text, 1, 300)) AS query FROM conversations WHERE role = 'user' AND text <> '' AND NOT starts_with(text, '<') AND NOT starts_with(text, 'System:') AND NOT starts_with(text, '[cron:') AND NOT starts_with(text, 'The ') ORDER BY conv_id, turn LIMIT 100"
TASKS = "t AS (SELECT *, 'task_' || (row_number() OVER (ORDER BY conv_id, turn, place) - 1) AS task_id FROM p)"
SQL["label_tasks"] = f"WITH {PAIRS_OF}, {TASKS} SELECT task_id, conv_id, turn, place FROM t"


def shared(words: dict[str, list[str]]) -> str:
    one = lambda c: "list_filter([" + ", ".join(f"CASE WHEN {any_of(f'lower({c})', [w.lower() for w in ws])} THEN {lit(k)} END" for k, ws in words.items()) + "], lambda x: x IS NOT NULL)"
    return f"list_filter({one('query')}, lambda x: list_contains({one('memory')}, x))"


KEYS = {w: [w] for w in ("nation", "tion", "ing", "die", "que")}
TOPIC = {"north": ["tion", "ing"], "south": ["que", "los"], "east": ["ver", "schaft"]}
SQL["auto_label"] = f"WITH {PAIRS_OF}, s AS (SELECT *, {shared(KEYS)} AS s FROM p) SELECT conv_id, turn, place, coalesce(array_to_string(s, ','), '') AS shared, (len(s) > 0)::BIGINT AS auto_label, CASE WHEN len(s) > 0 THEN 'high' ELSE 'low' END AS confidence FROM s"
SQL["topic_label"] = f"WITH {PAIRS_OF}, s AS (SELECT *, {shared(TOPIC)} AS s FROM p) SELECT conv_id, turn, place, coalesce(array_to_string(s, ','), '') AS common, (len(s) > 0)::BIGINT AS topic_label FROM s"
MERGED = f"{PAIRS_OF}, {TASKS}, a AS (SELECT *, len({shared(KEYS)}) > 0 AS hit FROM t), m AS (SELECT task_id, CASE WHEN conv_id % 3 = 0 THEN turn % 2 WHEN hit THEN 1 END AS label FROM a)"
SQL["merge_labels"] = f"WITH {MERGED} SELECT task_id, label::BIGINT AS label FROM m WHERE label IS NOT NULL"
SQL["label_counts"] = f"WITH {MERGED} SELECT label::BIGINT AS label, count(*) AS n FROM m WHERE label IS NOT NULL GROUP BY label"

# --- Store ------------------------------------------------------------------------------------------------------------

SQL["latest_upsert"] = "SELECT user_id, event_id, event_type, round(value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1"
SQL["access_counts"] = f"WITH {MEM}, r AS (SELECT user_id, count(*) AS n, max(ts) AS ts FROM events WHERE event_type = 'view' GROUP BY user_id) SELECT id, coalesce(n, 0) AS access_count, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at FROM mem LEFT JOIN r ON user_id = id"
SQL["cache_evict"] = "SELECT event_id FROM events WHERE floor(epoch((SELECT max(ts) FROM events))) - floor(epoch(ts)) < 7 * 86400 ORDER BY ts DESC, event_id LIMIT 50"
SQL["directory_listing"] = f"""WITH {MEM}, own AS (SELECT '/agent/' || category AS path FROM mem),
paths AS (SELECT DISTINCT path FROM (SELECT path FROM own UNION ALL SELECT unnest({arr(fixed.STANDARD_DIRECTORIES)}))),
s AS (SELECT list_filter(string_split(path, '/'), lambda x: x <> '') AS ps FROM paths),
e AS (SELECT ps, unnest(range(1, len(ps) + 1)) AS i FROM s),
d AS (SELECT DISTINCT '/' || array_to_string(ps[1:i], '/') AS path, CASE WHEN i = 1 THEN '' ELSE '/' || array_to_string(ps[1:i - 1], '/') END AS parent FROM e)
SELECT path, (SELECT count(*) FROM d k WHERE k.parent = d.path) AS children, (SELECT count(*) FROM own WHERE own.path = d.path) AS memories FROM d"""
SQL["trajectory_counts"] = f"""{BOTH}, fused AS ({top(rrf(1), 20)}), q AS (SELECT id AS doc_id, {LONG_SQL} AS quality FROM mem),
kept AS (SELECT query_id FROM fused JOIN q USING (doc_id) WHERE quality >= 0.85)
SELECT query_id, 1 AS step, 'bm25' AS stage, count(*) AS "rows" FROM lex GROUP BY query_id UNION ALL SELECT query_id, 2, 'vector', count(*) FROM near GROUP BY query_id
UNION ALL SELECT query_id, 3, 'fusion', count(*) FROM fused GROUP BY query_id UNION ALL SELECT query_id, 4, 'quality', count(*) FROM kept GROUP BY query_id"""
SQL["last_entries"] = "SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 3"

# --- Learners: a recursive fold -----------------------------------------------------------------------------------------

_F = list(FEATURES)
EVENTS = f"""{MEM}, ev AS MATERIALIZED (SELECT lang AS domain, id, row_number() OVER (PARTITION BY lang ORDER BY id) AS rn, l.quality::DOUBLE AS y,
  {", ".join(f"{c} AS f{i}" for i, c in enumerate(FEATURES.values()))} FROM mem JOIN labels l ON l.doc_id = id)"""
_ERROR = "(y - least(1.0, greatest(0.0, " + " * ".join(f"(w{i} * f{i})" for i in range(6)) + ")))"


def fold(low: float, high: float, rate: float, warm_up: int) -> str:
    move = lambda i: f"CASE WHEN ev.rn < {warm_up} THEN w{i} ELSE least({high}::DOUBLE, greatest({low}::DOUBLE, w{i} + {rate}::DOUBLE * {_ERROR} * f{i})) END"
    return f"""run AS (SELECT DISTINCT domain, 0::BIGINT AS n, {", ".join(f"1.0::DOUBLE AS w{i}" for i in range(6))} FROM ev
UNION ALL SELECT ev.domain, ev.rn, {", ".join(move(i) for i in range(6))} FROM run JOIN ev ON ev.domain = run.domain AND ev.rn = run.n + 1)"""


def weights(low: float, high: float, rate: float, warm_up: int) -> str:
    return f"WITH RECURSIVE {EVENTS}, {fold(low, high, rate, warm_up)} SELECT domain, n AS events, {', '.join(f'round(w{i}, 6) AS {k}' for i, k in enumerate(_F))} FROM run QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC) = 1"


SQL["adaptive_weights"] = weights(0.1, 2.0, 0.1, 0)
SQL["semi_adaptive_weights"] = weights(0.8, 1.2, 0.05, 10)
_LOGS = " UNION ALL ".join(f"SELECT a.domain, '{k}' AS feature, (b.w{i} - a.w{i}) / a.w{i} AS change FROM run a JOIN run b ON b.domain = a.domain AND b.n = a.n + 1" for i, k in enumerate(_F))
SQL["adjustment_log"] = f"WITH RECURSIVE {EVENTS}, {fold(0.8, 1.2, 0.05, 10)}, l AS ({_LOGS}) SELECT domain, feature, count(*) AS n, round(sum(change), 6) AS change, count(*) FILTER (abs(change) > 0.1) AS reviews FROM l WHERE abs(change) > 0.01 GROUP BY domain, feature"
SQL["weights_resumed"] = SQL["ordered_stream_weights"] = SQL["adaptive_weights"]
_PLAIN = EVENTS.replace(f"{FEATURES['type']} AS f0", "1.0::DOUBLE AS f0").replace(f"{FEATURES['entity']} AS f2", "0.8::DOUBLE AS f2").replace(f"{FEATURES['metadata']} AS f5", "1.0::DOUBLE AS f5")
SQL["batch_update_weights"] = SQL["adaptive_weights"].replace(EVENTS, _PLAIN)
_BASE = (0.9, 1.1, 1.0, 1.0, 1.0, 1.0)
_LAST = "run QUALIFY row_number() OVER (PARTITION BY domain ORDER BY n DESC) = 1"
SQL["effective_weights"] = f"WITH RECURSIVE {EVENTS}, {fold(0.8, 1.2, 0.05, 10)} SELECT domain, n AS events, {', '.join(f'round({b} * w{i}, 6) AS {k}' for i, (k, b) in enumerate(zip(_F, _BASE, strict=True)))} FROM {_LAST}"
_LOGGED = " UNION ALL ".join(f"SELECT a.domain, b.n, '{k}' AS feature, (b.w{i} - a.w{i}) / a.w{i} AS change FROM run a JOIN run b ON b.domain = a.domain AND b.n = a.n + 1" for i, k in enumerate(_F))
SQL["learner_report"] = f"""WITH RECURSIVE {EVENTS}, {fold(0.8, 1.2, 0.05, 10)}, l AS (SELECT l.*, id, row_number() OVER (PARTITION BY l.domain ORDER BY id DESC, feature) AS r FROM ({_LOGGED}) l JOIN ev ON ev.domain = l.domain AND ev.rn = l.n WHERE abs(change) > 0.01),
g AS (SELECT domain, count(*) AS changes, string_agg(id || ':' || feature, ',' ORDER BY r) FILTER (r <= 20) AS last_changes, count(*) FILTER (r <= 100 AND abs(change) > 0.1) AS pending FROM l GROUP BY domain),
e AS (SELECT * FROM {_LAST})
SELECT e.domain, n AS events, {', '.join(f'{b}::DOUBLE AS base_{k}, round(w{i}, 6) AS adjustment_{k}, round({b} * w{i}, 6) AS effective_{k}' for i, (k, b) in enumerate(zip(_F, _BASE, strict=True)))},
  coalesce(changes, 0) AS changes, coalesce(last_changes, '') AS last_changes, coalesce(pending, 0) AS pending FROM e LEFT JOIN g ON g.domain = e.domain"""

ORACLE_SQL = SQL
