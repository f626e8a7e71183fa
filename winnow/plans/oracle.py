"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each string runs on DuckDB with the driver's tables registered as views.
Column names match ``queries.py``; scores are rounded to 9 digits.
"""

from __future__ import annotations

from winnow.functions.hashing import sql_draw_key
from winnow.functions.text import (sql_strip, sql_tokenize_alnum, sql_tokenize_whitespace,
                                   sql_ws29)

K1, B = 1.5, 0.75

CORPUS = (f"d AS (SELECT doc_id AS example_id, {sql_tokenize_alnum('text')} AS tokens "
          f"FROM documents)")
QUERIES = (f"q AS (SELECT item_id AS query_id, {sql_tokenize_alnum('text')} AS tokens "
           f"FROM benchmark)")


def tfnorm(tf="tf", dl="dl", avgdl="avgdl", k1=K1, b=B):
    return f"({tf} * {k1 + 1.0} / ({tf} + {k1} * ({1.0 - b} + {b} * {dl} / {avgdl})))"


def idf(n="n_docs", df="df"):
    return f"ln(1 + ({n} - {df} + 0.5) / ({df} + 0.5))"


# Shared CTE chain: corpus stats, tf, df over the corpus (alnum tokens).
BM25_BASE = f"""
{CORPUS},
st AS (SELECT count(*) AS n_docs, avg(len(tokens)) AS avgdl FROM d),
tf AS (SELECT example_id, dl, term, count(*) AS tf
       FROM (SELECT example_id, len(tokens) AS dl, unnest(tokens) AS term FROM d)
       GROUP BY example_id, dl, term),
dfq AS (SELECT term, count(*) AS df FROM tf GROUP BY term)"""


def bm25_mean_sql(queries_cte: str) -> str:
    """CTE chain ending in ``sc(example_id, score)`` for the mean over queries ``q``."""
    return f"""WITH {BM25_BASE},
{queries_cte},
nq AS (SELECT count(*) AS n_queries FROM q),
qt AS (SELECT DISTINCT query_id, unnest(tokens) AS term FROM q),
qn AS (SELECT term, count(*) AS qn FROM qt GROUP BY term),
w AS (SELECT qn.term, {idf('st.n_docs', 'dfq.df')} * qn.qn / nq.n_queries AS w
      FROM qn JOIN dfq ON qn.term = dfq.term CROSS JOIN st CROSS JOIN nq),
contrib AS (SELECT tf.example_id, sum(w.w * {tfnorm('tf.tf', 'tf.dl', 'st.avgdl')}) AS s
            FROM tf JOIN w ON tf.term = w.term CROSS JOIN st GROUP BY tf.example_id),
sc AS (SELECT d.example_id, coalesce(contrib.s, 0.0) AS score
       FROM d LEFT JOIN contrib ON d.example_id = contrib.example_id)"""


def bm25_pairs_sql() -> str:
    return f"""WITH {BM25_BASE},
{QUERIES},
qt AS (SELECT DISTINCT query_id, unnest(tokens) AS term FROM q),
pairs AS (SELECT qt.query_id, tf.example_id,
                 sum({idf('st.n_docs', 'dfq.df')} * {tfnorm('tf.tf', 'tf.dl', 'st.avgdl')}) AS score
          FROM qt JOIN tf ON qt.term = tf.term JOIN dfq ON dfq.term = tf.term CROSS JOIN st
          GROUP BY qt.query_id, tf.example_id)"""


def sig(x: str) -> str:
    """Ten significant digits."""
    return f"(CAST(printf('%.9e', {x}) AS DOUBLE) + 0.0)"


PICK = f"SELECT example_id, {sig('score')} AS score FROM sc"


def topk_sql(scores_cte_sql: str, budget: float, n_expr: str = "(SELECT count(*) FROM sc)") -> str:
    """Append top-k (k from the budget) on ``sc(example_id, score)``."""
    if budget <= 1:
        raw = f"CAST(round_even({float(budget)} * {n_expr}, 0) AS BIGINT)"
    else:
        raw = str(int(budget))
    k = f"greatest(1, least({n_expr}, {raw}))"
    return f"""{scores_cte_sql}
{PICK}
QUALIFY row_number() OVER (ORDER BY {sig('score')} DESC NULLS LAST, example_id) <= {k}"""


SELF_QUERIES = "q AS (SELECT example_id AS query_id, tokens FROM d)"

WS_DOCS = f"x AS (SELECT doc_id AS example_id, {sql_tokenize_whitespace('text')} AS tokens FROM documents)"
WS_ANCHORS = f"a AS (SELECT item_id AS anchor_id, {sql_tokenize_whitespace('text')} AS tokens FROM benchmark)"

BM25_ANCHOR = f"""WITH {WS_DOCS}, {WS_ANCHORS},
ast AS (SELECT greatest(count(*), 1) AS n_a,
               CASE WHEN coalesce(sum(len(tokens)), 0) / greatest(count(*), 1) = 0 THEN 1.0
                    ELSE coalesce(sum(len(tokens)), 0) / greatest(count(*), 1) END AS avgdl FROM a),
atf AS (SELECT anchor_id, dl, term, count(*) AS tf
        FROM (SELECT anchor_id, len(tokens) AS dl, unnest(tokens) AS term FROM a)
        GROUP BY anchor_id, dl, term),
adf AS (SELECT term, count(*) AS df FROM atf GROUP BY term),
w AS (SELECT atf.term, sum({idf('ast.n_a', 'adf.df')} * {tfnorm('atf.tf', 'atf.dl', 'ast.avgdl')} / ast.n_a) AS w
      FROM atf JOIN adf ON atf.term = adf.term CROSS JOIN ast GROUP BY atf.term),
xt AS (SELECT DISTINCT example_id, unnest(tokens) AS term FROM x),
sc AS (SELECT x.example_id, coalesce(s.score, 0.0) AS score FROM x LEFT JOIN
       (SELECT xt.example_id, sum(w.w) AS score FROM xt JOIN w ON xt.term = w.term GROUP BY xt.example_id) s
       ON x.example_id = s.example_id)"""


ORACLE = {
    "select_bm25": topk_sql(bm25_mean_sql(QUERIES), 0.05),
    "tokenize_alnum": f"""WITH {CORPUS}
SELECT example_id, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM d""",
    "tokenize_whitespace": f"""WITH {WS_DOCS}
SELECT example_id, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM x""",
    "term_frequency": f"""WITH {CORPUS}
SELECT example_id, term, count(*) AS tf FROM (SELECT example_id, unnest(tokens) AS term FROM d)
GROUP BY example_id, term""",
    "doc_length_stats": f"""WITH {CORPUS}
SELECT count(*) AS n_docs, round(avg(len(tokens)), 9) AS avgdl FROM d""",
    "inverse_doc_frequency": f"""WITH {BM25_BASE}
SELECT term, df, round({idf('st.n_docs', 'df')}, 9) AS idf FROM dfq CROSS JOIN st""",
    "bm25_pairs": bm25_pairs_sql() + "\nSELECT query_id, example_id, round(score, 9) AS score FROM pairs",
    "bm25_mean": bm25_mean_sql(QUERIES) + "\nSELECT example_id, round(score, 9) AS score FROM sc",
    "bm25_max": bm25_pairs_sql() + """,
best AS (SELECT example_id, max(score) AS best FROM pairs GROUP BY example_id)
SELECT d.example_id, round(greatest(coalesce(best.best, 0.0), 0.0), 9) AS score
FROM d LEFT JOIN best ON d.example_id = best.example_id""",
    "bm25_self": bm25_mean_sql(SELF_QUERIES) + "\nSELECT example_id, round(score, 9) AS score FROM sc",
    "bm25_anchor": BM25_ANCHOR + "\nSELECT example_id, round(score, 9) AS score FROM sc",
    "standardize": BM25_ANCHOR + """,
m AS (SELECT avg(score) AS mu, stddev_samp(score) AS sd FROM sc)
SELECT example_id, round((score - mu) / (sd + 1e-8), 9) AS score FROM sc CROSS JOIN m""",
    "budget_to_k": """SELECT count(*) AS n,
greatest(1, least(count(*), CAST(round_even(0.05 * count(*), 0) AS BIGINT))) AS k FROM documents""",
    "topk_by_score": topk_sql(bm25_mean_sql(QUERIES), 0.1),
}

__all__ = ["ORACLE", "sql_strip", "sql_ws29"]


# --- records ------------------------------------------------------------------
WS = sql_ws29()


def strip(e: str) -> str:
    return f"trim(coalesce({e}, ''), {WS})"


ALPACA_RAW = """araw AS (SELECT doc_id AS example_id, split_part(text, chr(10), 1) AS instruction,
    CASE WHEN lang = 'en' THEN NULL ELSE source END AS input,
    substr(text, length(split_part(text, chr(10), 1)) + 2) AS output FROM documents)"""

ALPACA = ALPACA_RAW + f""",
alp AS (SELECT example_id, {strip('instruction')} AS instruction, {strip('input')} AS input,
        {strip('output')} AS output FROM araw
        WHERE {strip('instruction')} <> '' AND {strip('output')} <> '')"""

ROLE_TAG = ("CASE role WHEN 'system' THEN 'System' WHEN 'user' THEN 'User' "
            "WHEN 'assistant' THEN 'Assistant' ELSE coalesce(role, '') END")

CHAT = f"""la AS (SELECT conv_id, max(turn) AS last_turn FROM conversations
       WHERE role = 'assistant' AND {strip('text')} <> '' GROUP BY conv_id),
h AS (SELECT c.conv_id, c.turn, c.role, c.text FROM conversations c JOIN la ON c.conv_id = la.conv_id
      WHERE c.turn < la.last_turn),
hs AS (SELECT conv_id, count(*) AS n_hist, arg_min(role, turn) AS first_role,
              arg_min({strip('text')}, turn) AS first_text,
              string_agg({ROLE_TAG} || ': ' || {strip('text')}, chr(10) || chr(10) ORDER BY turn)
                FILTER (WHERE {strip('text')} <> '') AS tagged
       FROM h GROUP BY conv_id),
chat AS (SELECT * FROM (
   SELECT la.conv_id AS example_id,
          CASE WHEN hs.n_hist = 1 AND hs.first_role = 'user' THEN hs.first_text
               ELSE coalesce(hs.tagged, '') END AS instruction,
          '' AS input, {strip('o.text')} AS output
   FROM la LEFT JOIN hs ON la.conv_id = hs.conv_id
   JOIN conversations o ON o.conv_id = la.conv_id AND o.turn = la.last_turn) WHERE instruction <> '')"""

SHAREGPT = f"""sg AS (SELECT conv_id, turn,
        CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS frm,
        {strip('text')} AS v FROM conversations),
hh AS (SELECT conv_id, min(turn) AS ht FROM sg WHERE frm = 'human' AND v <> '' GROUP BY conv_id),
gg AS (SELECT sg.conv_id, min(sg.turn) AS gt FROM sg JOIN hh ON sg.conv_id = hh.conv_id
       WHERE sg.frm = 'gpt' AND sg.v <> '' AND sg.turn > hh.ht GROUP BY sg.conv_id),
pair AS (SELECT hh.conv_id AS example_id, hx.v AS instruction, gx.v AS output
         FROM hh JOIN gg ON hh.conv_id = gg.conv_id
         JOIN sg hx ON hx.conv_id = hh.conv_id AND hx.turn = hh.ht
         JOIN sg gx ON gx.conv_id = gg.conv_id AND gx.turn = gg.gt)"""


def prompt_sql(ins="instruction", inp="input") -> str:
    i = strip(inp)
    return ("'Below is an instruction that describes a task' || "
            f"CASE WHEN {i} <> '' THEN ', paired with an input' ELSE '' END || "
            "'. Write a response that appropriately completes the request.' || chr(10) || chr(10) || "
            "'### Instruction:' || chr(10) || " + strip(ins) + " || chr(10) || chr(10) || "
            f"CASE WHEN {i} <> '' THEN '### Input:' || chr(10) || {i} || chr(10) || chr(10) ELSE '' END || "
            "'### Response:' || chr(10)")


TOK0 = f"""tok0 AS (SELECT example_id, {sql_tokenize_whitespace(prompt_sql())} AS ptoks,
        {sql_tokenize_whitespace(strip('output'))} AS otoks FROM chat)"""
TOK = f"""{TOK0},
tok AS (SELECT example_id, list_slice(list_concat(ptoks, otoks, ['</s>']), 1, 2048) AS tokens,
        CAST(least(len(ptoks), 2048) AS BIGINT) AS n_prompt FROM tok0)"""

WHOLE_TOK = f"""{TOK0},
tok AS (SELECT example_id, list_concat(ptoks, otoks, ['</s>']) AS tokens,
        CAST(len(ptoks) AS BIGINT) AS n_prompt FROM tok0)"""

SCORES = bm25_mean_sql(QUERIES)


def draw(seed, salt, col):
    return sql_draw_key(seed, salt, col)


ORACLE.update({
    "materialize_subset": topk_sql(SCORES, 0.05).replace(
        PICK,
        "SELECT sc.example_id, documents.lang, documents.source FROM sc "
        "JOIN documents ON documents.doc_id = sc.example_id"),
    "invalid_sink": topk_sql(SCORES + """,
sc2 AS (SELECT sc.example_id, CASE WHEN documents.lang = 'en' THEN sc.score END AS score
        FROM sc JOIN documents ON documents.doc_id = sc.example_id)""", 0.5).replace(
        "FROM sc\nQUALIFY", "FROM sc2\nQUALIFY").replace("(SELECT count(*) FROM sc)", "(SELECT count(*) FROM sc2)"),
    "score_direction": topk_sql(SCORES + ",\nneg AS (SELECT example_id, -score AS score FROM sc)", 0.05)
        .replace("FROM sc\nQUALIFY", "FROM neg\nQUALIFY"),
    "policy_hard": SCORES + f""",
top AS (SELECT example_id FROM sc QUALIFY row_number() OVER (ORDER BY {sig('score')} DESC NULLS LAST, example_id)
        <= greatest(1, least((SELECT count(*) FROM sc), CAST(round_even(0.05 * (SELECT count(*) FROM sc), 0) AS BIGINT))))
SELECT sc.example_id, CAST(CASE WHEN top.example_id IS NULL THEN 0.0 ELSE 1.0 END AS DOUBLE) AS weight
FROM sc LEFT JOIN top ON sc.example_id = top.example_id""",
    "select_all": "SELECT doc_id AS example_id FROM documents",
    "alpaca_record": f"WITH {ALPACA} SELECT * FROM alp",
    "chat_to_record": f"WITH {CHAT} SELECT * FROM chat",
    "sharegpt_first_pair": f"WITH {SHAREGPT} SELECT * FROM pair",
    "evol_record": f"""WITH {SHAREGPT}, {ALPACA_RAW}
SELECT 'chat' AS origin, example_id, instruction, '' AS input, output FROM pair
UNION ALL
SELECT 'doc' AS origin, example_id, {strip('instruction')} AS instruction, '' AS input, {strip('output')} AS output
FROM araw WHERE {strip('instruction')} <> '' AND {strip('output')} <> ''""",
    "format_prompt": f"WITH {ALPACA} SELECT example_id, {prompt_sql()} AS text FROM alp",
    "tokenize_mask": f"""WITH {CHAT}, {TOK}
SELECT example_id, CAST(len(tokens) AS BIGINT) AS n_tokens, n_prompt, array_to_string(tokens, ' ') AS tokens FROM tok""",
    "response_tokens": f"""WITH {CHAT}, {WHOLE_TOK}
SELECT example_id, CAST(greatest(len(tokens) - n_prompt, 0) AS BIGINT) AS n_response,
       CASE WHEN len(tokens) > n_prompt THEN array_to_string(list_slice(tokens, n_prompt + 1, len(tokens)), ' ')
            ELSE '' END AS response FROM tok""",
    "scorable_flag": f"WITH {CHAT}, {TOK} SELECT example_id, len(tokens) > n_prompt AS scorable FROM tok",
    "read_records": "SELECT * FROM documents",
    "read_chat_sources": f"""WITH {CHAT}
SELECT CASE WHEN example_id % 2 = 0 THEN 'dolly' ELSE 'oasst1' END AS dataset, * FROM chat""",
    "write_jsonl": f"WITH {ALPACA} SELECT * FROM alp",
    "build_if_missing": f"WITH {CHAT} SELECT * FROM chat",
    "selection_manifest": topk_sql(SCORES, 0.05).replace(
        PICK + "\nQUALIFY",
        "SELECT 'bm25' AS method, CAST(0.05 AS DOUBLE) AS budget, count(*) AS num_selected, "
        "bit_xor(('0x' || substr(md5(CAST(example_id AS VARCHAR)), 1, 15))::BIGINT) AS id_checksum, min(example_id) AS min_id, max(example_id) AS max_id "
        "FROM (SELECT example_id FROM sc\nQUALIFY") + ")",
    "dataset_sizes": """WITH n AS (SELECT count(*) AS n FROM documents)
SELECT 'train' AS split, n - CAST(ceil(n * 0.05) AS BIGINT) AS n FROM n
UNION ALL SELECT 'validation' AS split, CAST(ceil(n * 0.05) AS BIGINT) AS n FROM n""",
    "subsample_fraction": f"""SELECT doc_id AS example_id FROM documents
QUALIFY row_number() OVER (ORDER BY {draw(3, 'subsample', 'doc_id')}, doc_id)
        <= CAST(round_even(0.3 * count(*) OVER (), 0) AS BIGINT)""",
    "mix_sources": f"""SELECT source AS dataset, doc_id AS example_id,
       {sql_draw_key(3, 'shuffle', 'source', 'doc_id')} AS shuffle_key FROM documents
QUALIFY row_number() OVER (PARTITION BY source ORDER BY {draw(3, 'subsample', 'doc_id')}, doc_id)
        <= CAST(round_even(0.5 * count(*) OVER (PARTITION BY source), 0) AS BIGINT)""",
    "mixture_stats": """SELECT source AS dataset, count(*) AS available,
       CAST(round_even(0.5 * count(*), 0) AS BIGINT) AS kept FROM documents GROUP BY source""",
    "train_val_split": f"""SELECT doc_id AS example_id,
  CASE WHEN row_number() OVER (ORDER BY {draw(42, 'split', 'doc_id')}, doc_id)
            <= CAST(ceil(0.05 * count(*) OVER ()) AS BIGINT) THEN 'validation' ELSE 'train' END AS split
FROM documents""",
    "select_random": f"""SELECT doc_id AS example_id FROM documents
QUALIFY row_number() OVER (ORDER BY {draw(42, 'random', 'doc_id')}, doc_id)
        <= greatest(1, least(count(*) OVER (), CAST(round_even(0.05 * count(*) OVER (), 0) AS BIGINT)))""",
    "warmup_subset": f"""SELECT doc_id AS example_id FROM documents
QUALIFY row_number() OVER (ORDER BY {draw(42, 'warmup', 'doc_id')}, doc_id)
        <= greatest(1, least(count(*) OVER (), CAST(round_even(0.01 * count(*) OVER (), 0) AS BIGINT)))""",
    "cluster_round_robin": f"""SELECT example_id, label FROM (
  SELECT vec_id AS example_id, label,
         row_number() OVER (PARTITION BY label ORDER BY {draw(42, 'cluster', 'vec_id')}, vec_id) AS rnd
  FROM embeddings) ORDER BY rnd, label LIMIT 50""",
    "query_sample": f"""SELECT doc_id AS example_id FROM documents
ORDER BY {draw(42, 'queries', 'doc_id')}, doc_id LIMIT 256""",
})


# --- vectors ------------------------------------------------------------------

def _norm(v: str) -> str:
    return f"sqrt(list_sum(list_transform({v}, lambda x: x * x)))"


EMB = f"""es AS (SELECT vec_id AS example_id, list_transform(embedding, lambda x: x::DOUBLE) AS v, label,
   CASE WHEN row_number() OVER (ORDER BY {draw(42, 'split', 'vec_id')}, vec_id)
             <= CAST(ceil(0.05 * count(*) OVER ()) AS BIGINT) THEN 'validation' ELSE 'train' END AS split
   FROM embeddings),
tr AS (SELECT example_id, v FROM es WHERE split = 'train'),
va AS (SELECT example_id, v FROM es WHERE split = 'validation')"""


def centroid_cte(name: str, src: str, col: str = "v") -> str:
    return f"""{name} AS (SELECT list(x ORDER BY dim) AS c FROM (
   SELECT dim, avg(x) AS x FROM (SELECT generate_subscripts({col}, 1) AS dim, unnest({col}) AS x FROM {src})
   GROUP BY dim))"""


BITS = "lpad(bin(('0x' || substr(md5('42:tokvec:' || tok), 1, 16))::UBIGINT), 64, '0')"
SIGN = "(CASE WHEN substr(bits, dim + 1, 1) = '1' THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END)"


def mean_pool_sql(src_cte: str, id_col: str = "example_id") -> str:
    """CTE chain (after ``src_cte`` defining x(id, tokens)) ending in mp(id, dim, value)."""
    return f"""{src_cte},
dims AS (SELECT range AS dim FROM range(64)),
tk AS (SELECT {id_col}, len(tokens) AS n, unnest(tokens) AS tok FROM x),
bt AS (SELECT {id_col}, n, {BITS} AS bits FROM tk),
s1 AS (SELECT {id_col}, dim, sum({SIGN}) / greatest(any_value(n), 1) AS value FROM bt CROSS JOIN dims
       GROUP BY {id_col}, dim),
mp AS (SELECT x.{id_col}, dims.dim, coalesce(s1.value, 0.0) AS value FROM x CROSS JOIN dims
       LEFT JOIN s1 ON s1.{id_col} = x.{id_col} AND s1.dim = dims.dim)"""


def position_pool_sql(src_cte: str, id_col: str = "example_id", out: str = "pp") -> str:
    """CTE chain ending in ``{out}(id, dim, value)``: position-weighted, unit (eps 1e-8)."""
    return f"""{src_cte},
dims AS (SELECT range AS dim FROM range(64)),
tk AS (SELECT {id_col}, len(tokens) AS n, unnest(tokens) AS tok, generate_subscripts(tokens, 1) AS pos FROM x),
bt AS (SELECT {id_col}, n, pos, {BITS} AS bits FROM tk),
s1 AS (SELECT {id_col}, dim, sum(pos * {SIGN}) / greatest(any_value(n) * (any_value(n) + 1.0) / 2.0, 1.0) AS value
       FROM bt CROSS JOIN dims GROUP BY {id_col}, dim),
ph AS (SELECT x.{id_col}, dims.dim, coalesce(s1.value, 0.0) AS value FROM x CROSS JOIN dims
       LEFT JOIN s1 ON s1.{id_col} = x.{id_col} AND s1.dim = dims.dim),
nr AS (SELECT {id_col}, sqrt(sum(value * value)) AS nrm FROM ph GROUP BY {id_col}),
{out} AS (SELECT ph.{id_col}, ph.dim, ph.value / greatest(nr.nrm, 1e-8) AS value FROM ph JOIN nr
       ON ph.{id_col} = nr.{id_col})"""


def gate_sql(score: str, tau=1.0, w_min=0.0, w_max=10.0) -> str:
    return f"least(greatest(1.0 / (1.0 + exp(-({score}) / {float(tau)})), {float(w_min)}), {float(w_max)})"


BM25_STD = BM25_ANCHOR + """,
mstd AS (SELECT avg(score) AS mu, stddev_samp(score) AS sd FROM sc),
scz AS (SELECT example_id, (score - mu) / (sd + 1e-8) AS score FROM sc CROSS JOIN mstd)"""

PP_DOCS = position_pool_sql(WS_DOCS.replace("x AS", "x AS", 1))
EVENTS_B = """eb AS (SELECT event_id AS example_id, CAST(floor(event_id / 8) AS BIGINT) AS batch_id,
                   value AS loss FROM events)"""

ORACLE.update({
    "encode_mean_pool": "WITH " + mean_pool_sql(WS_DOCS) +
        "\nSELECT example_id, dim, round(value, 9) AS value FROM mp",
    "encode_position_pool": "WITH " + PP_DOCS + "\nSELECT example_id, dim, round(value, 9) AS value FROM pp",
    "token_ppmi": f"""WITH {WS_DOCS},
tp AS (SELECT example_id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM x),
co AS (SELECT a.token, b.token AS ctx, sum(5 - abs(a.pos - b.pos)) AS c
       FROM tp a JOIN (SELECT * FROM tp) b ON a.example_id = b.example_id AND b.pos BETWEEN a.pos - 4 AND a.pos + 4
                                          AND b.pos <> a.pos
       GROUP BY a.token, b.token),
mg AS (SELECT token, sum(c) AS m FROM co GROUP BY token),
al AS (SELECT sum(m)::DOUBLE AS total FROM mg)
SELECT co.token, co.ctx, round(ln(co.c::DOUBLE * al.total / (t.m::DOUBLE * u.m::DOUBLE)), 9) AS ppmi
FROM co JOIN mg t ON t.token = co.token JOIN mg u ON u.token = co.ctx CROSS JOIN al
WHERE ln(co.c::DOUBLE * al.total / (t.m::DOUBLE * u.m::DOUBLE)) > 0""",
    "l2_normalize": f"""WITH e AS (SELECT vec_id AS example_id, list_transform(embedding, lambda x: x::DOUBLE) AS v
    FROM embeddings)
SELECT example_id, CAST(dim - 1 AS BIGINT) AS dim, round(x / greatest(nrm, 1e-12), 9) AS value FROM (
  SELECT example_id, {_norm('v')} AS nrm, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM e)""",
    "centroid": """WITH e AS (SELECT list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)
SELECT CAST(dim - 1 AS BIGINT) AS dim, round(avg(x), 9) AS value FROM (
  SELECT generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM e) GROUP BY dim""",
    "cosine_to_centroid": f"""WITH {EMB}, {centroid_cte('cv', 'va')}
SELECT example_id, round(list_dot_product(v, c) / greatest({_norm('v')} * {_norm('c')}, 1e-8), 9) AS score
FROM tr CROSS JOIN cv""",
    "select_embedding": topk_sql(f"""WITH {EMB}, {centroid_cte('cv', 'va')},
sc AS (SELECT example_id, list_dot_product(v, c) / greatest({_norm('v')} * {_norm('c')}, 1e-8) AS score
       FROM tr CROSS JOIN cv)""", 0.05),
    "anchor_mean_cosine": f"""WITH {EMB},
ua AS (SELECT list_transform(v, lambda x: x / greatest({_norm('v')}, 1e-8)) AS u FROM va),
{centroid_cte('cv', 'ua', 'u')}
SELECT example_id, round(list_dot_product(list_transform(v, lambda x: x / greatest({_norm('v')}, 1e-8)), c), 9)
  AS score FROM tr CROSS JOIN cv""",
    "nearest_neighbor": f"""WITH u AS (SELECT vec_id AS id, list_transform(embedding, lambda x: x::DOUBLE) AS v0
    FROM embeddings),
uu AS (SELECT id, list_transform(v0, lambda x: x / greatest({_norm('v0')}, 1e-12)) AS v FROM u)
SELECT a.id AS example_id, b.id AS nn_id, round(list_dot_product(a.v, b.v), 9) AS sim
FROM uu a JOIN uu b ON a.id <> b.id
QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.v, b.v), 9) DESC, b.id) = 1""",
    "pairwise_similarity_agg": f"""WITH {EMB},
ut AS (SELECT example_id, list_transform(v, lambda x: x / greatest({_norm('v')}, 1e-12)) AS u FROM tr),
uv AS (SELECT example_id, list_transform(v, lambda x: x / greatest({_norm('v')}, 1e-12)) AS u FROM va),
{centroid_cte('cv', 'uv', 'u')},
mx AS (SELECT ut.example_id, max(round(list_dot_product(ut.u, uv.u), 9)) AS max_sim
       FROM ut CROSS JOIN uv GROUP BY ut.example_id)
SELECT ut.example_id, round(list_dot_product(ut.u, cv.c), 9) AS mean_sim, round(mx.max_sim, 9) AS max_sim
FROM ut CROSS JOIN cv JOIN mx ON mx.example_id = ut.example_id""",
    "sigmoid_gate": SCORES + f"\nSELECT example_id, round({gate_sql('score')}, 9) AS weight FROM sc",
    "policy_reweight": SCORES + f""",
m AS (SELECT avg(score) AS mu, stddev_samp(score) AS sd FROM sc)
SELECT example_id, round({gate_sql('(score - mu) / (sd + 1e-8)', 0.5, 0.05, 0.9)}, 9) AS weight
FROM sc CROSS JOIN m""",
    "weights_bm25": BM25_STD + f"""
SELECT example_id, round(score, 9) AS score, round({gate_sql('score')}, 9) AS weight FROM scz""",
    "weights_embed": "WITH " + position_pool_sql(WS_DOCS) + ",\n" + position_pool_sql(
        WS_ANCHORS.replace("a AS", "x AS", 1), "anchor_id", "pa").replace("dims AS (SELECT range AS dim FROM range(64)),\n", "")
        .replace("tk AS", "tka AS").replace("FROM tk)", "FROM tka)").replace("bt AS", "bta AS")
        .replace("FROM bt CROSS", "FROM bta CROSS").replace("s1 AS", "s1a AS").replace("s1.", "s1a.")
        .replace("LEFT JOIN s1 ON", "LEFT JOIN s1a ON").replace("ph AS", "pha AS").replace("ph.", "pha.")
        .replace("FROM ph ", "FROM pha ").replace("nr AS", "nra AS").replace("nr.", "nra.")
        .replace("JOIN nr\n", "JOIN nra\n").replace("x AS (SELECT", "xa AS (SELECT", 1)
        .replace("FROM x)", "FROM xa)").replace("FROM x CROSS", "FROM xa CROSS").replace("x.anchor_id", "xa.anchor_id")
        + """,
ac AS (SELECT dim, avg(value) AS c FROM pa GROUP BY dim),
ss AS (SELECT pp.example_id, sum(pp.value * ac.c) AS score FROM pp JOIN ac ON pp.dim = ac.dim GROUP BY pp.example_id)
SELECT example_id, round(score, 9) AS score, round(""" + gate_sql("score") + ", 9) AS weight FROM ss",
    "combine_weighted_loss": f"""WITH {EVENTS_B},
w AS (SELECT event_id AS example_id, {gate_sql('value / 10.0 - 1.0')} AS weight FROM events)
SELECT batch_id, round(sum(weight * loss) / greatest(sum(weight), 1e-8), 9) AS loss
FROM eb JOIN w ON eb.example_id = w.example_id GROUP BY batch_id""",
    "anchor_refresh": f"""WITH {EVENTS_B}, {EMB},
st AS (SELECT DISTINCT batch_id AS step, CAST(floor(batch_id / 50) * 50 AS BIGINT) AS version FROM eb),
al AS (SELECT example_id, generate_subscripts(v, 1) - 1 AS dim, unnest(v) / greatest({_norm('v')}, 1e-8) AS x FROM va),
ce AS (SELECT vs.version, al.dim, avg(al.x) AS value FROM (SELECT DISTINCT version FROM st) vs
       JOIN al ON al.example_id <= vs.version GROUP BY vs.version, al.dim)
SELECT st.step, st.version, CAST(ce.dim AS BIGINT) AS dim, round(ce.value, 9) AS value
FROM st LEFT JOIN ce ON ce.version = st.version""",
    "thread_row_id": "SELECT doc_id AS example_id, text FROM documents",
})


# --- language-model losses ------------------------------------------------------

def lm_sql(src: str = "bgx", prefix: str = "") -> str:
    """Count tables {prefix}uni, {prefix}bi, {prefix}pre, {prefix}tot over ``src(id, tokens)``."""
    p = prefix
    return f"""{p}bgp AS (SELECT id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM {src}),
{p}uni AS (SELECT token, count(*) AS c FROM {p}bgp GROUP BY token),
{p}bi AS (SELECT prev, token, count(*) AS c FROM (
    SELECT lag(token) OVER (PARTITION BY id ORDER BY pos) AS prev, token FROM {p}bgp)
    WHERE prev IS NOT NULL GROUP BY prev, token),
{p}pre AS (SELECT prev, sum(c) AS c_pre FROM {p}bi GROUP BY prev),
{p}tot AS (SELECT sum(c)::DOUBLE AS T, count(*)::DOUBLE AS V FROM {p}uni)"""


BG = f"bgx AS (SELECT doc_id AS id, {sql_tokenize_whitespace('text')} AS tokens FROM documents)"


def nll_sql(name: str, rows: str, cache: bool, lm: str = "") -> str:
    """``{name}(example_id, pos, nll)`` from ``rows(example_id, token, pos, prev)``;
    with ``cache``, ``{rows}_cc(example_id, token, cc)`` and ``{rows}_cl(example_id, clen)``."""
    puni = f"((coalesce({lm}uni.c, 0)::DOUBLE + 1.0) / ({lm}tot.T + {lm}tot.V + 1.0))"
    pbi = (f"(CASE WHEN coalesce({lm}pre.c_pre, 0) > 0 THEN coalesce({lm}bi.c, 0)::DOUBLE / {lm}pre.c_pre::DOUBLE "
           f"ELSE {puni} END)")
    if cache:
        pc = f"(CASE WHEN cl.clen > 0 THEN coalesce(cc.cc, 0)::DOUBLE / cl.clen ELSE 0.0 END)"
        p = f"0.4 * {pbi} + 0.3 * {puni} + 0.3 * {pc}"
        cj = (f"JOIN {rows}_cl cl ON cl.example_id = r.example_id "
              f"LEFT JOIN {rows}_cc cc ON cc.example_id = r.example_id AND cc.token = r.token")
    else:
        p = f"0.5 * {pbi} + 0.5 * {puni}"
        cj = ""
    return f"""{name} AS (SELECT r.example_id, r.pos, -ln({p}) AS nll FROM {rows} r {cj}
  LEFT JOIN {lm}uni ON {lm}uni.token = r.token
  LEFT JOIN {lm}bi ON {lm}bi.prev = r.prev AND {lm}bi.token = r.token
  LEFT JOIN {lm}pre ON {lm}pre.prev = r.prev CROSS JOIN {lm}tot)"""


COND_ROWS = """cp AS (SELECT example_id, n_prompt, tokens, unnest(tokens) AS token,
                   generate_subscripts(tokens, 1) - 1 AS i FROM tok),
cr AS (SELECT example_id, token, CAST(i AS BIGINT) AS pos, CASE WHEN i > 0 THEN tokens[i] END AS prev
       FROM cp WHERE i >= n_prompt),
cr_cc AS (SELECT example_id, token, count(*) AS cc FROM (
    SELECT example_id, unnest(list_slice(tokens, 1, n_prompt)) AS token FROM tok) GROUP BY example_id, token),
cr_cl AS (SELECT example_id, CAST(n_prompt AS DOUBLE) AS clen FROM tok)"""

DIRECT_ROWS = """dp AS (SELECT example_id, n_prompt, resp, unnest(resp) AS token, generate_subscripts(resp, 1) - 1 AS j
       FROM (SELECT example_id, n_prompt, list_slice(tokens, n_prompt + 1, len(tokens)) AS resp FROM tok)),
dr AS (SELECT example_id, token, CAST(j + n_prompt AS BIGINT) AS pos, resp[j] AS prev FROM dp WHERE j >= 1)"""

G_BASE = f"WITH {CHAT}, {WHOLE_TOK}, {BG}, {lm_sql()}"
COND_LOSS = f"""{COND_ROWS},
{nll_sql('nc', 'cr', True)},
cl_loss AS (SELECT tok.example_id, l.loss FROM tok LEFT JOIN
   (SELECT example_id, avg(nll) AS loss FROM nc GROUP BY example_id) l ON l.example_id = tok.example_id)"""
DIRECT_LOSS = f"""{DIRECT_ROWS},
{nll_sql('nd', 'dr', False)},
dl_loss AS (SELECT tok.example_id, CASE WHEN len(tok.tokens) - tok.n_prompt >= 2 THEN l.loss END AS loss
   FROM tok LEFT JOIN (SELECT example_id, avg(nll) AS loss FROM nd GROUP BY example_id) l
   ON l.example_id = tok.example_id)"""
IFD = f"""{G_BASE}, {COND_LOSS}, {DIRECT_LOSS},
ifd AS (SELECT c.example_id, CASE WHEN d.loss > 0 THEN c.loss / d.loss END AS score
        FROM cl_loss c FULL JOIN dl_loss d ON c.example_id = d.example_id)"""

PROMPT_X = f"x AS (SELECT example_id, {sql_tokenize_whitespace(prompt_sql())} AS tokens FROM chat)"
NN = mean_pool_sql(PROMPT_X) + """,
nrm AS (SELECT example_id, greatest(sqrt(sum(value * value)), 1e-12) AS n FROM mp GROUP BY example_id),
um AS (SELECT mp.example_id, mp.dim, mp.value / nrm.n AS u FROM mp JOIN nrm ON mp.example_id = nrm.example_id),
sims AS (SELECT a.example_id, b.example_id AS nn_id, round(sum(a.u * b.u), 9) AS sim
         FROM um a JOIN um b ON a.dim = b.dim AND a.example_id <> b.example_id GROUP BY a.example_id, b.example_id),
nn AS (SELECT example_id, nn_id FROM sims
       QUALIFY row_number() OVER (PARTITION BY example_id ORDER BY sim DESC, nn_id) = 1)"""
CUT_CTX = """ctx AS (SELECT t.example_id, nn.nn_id,
          CASE WHEN 2048 - len(t.tokens) <= 0 THEN []::VARCHAR[]
               ELSE list_slice(c.tokens, len(c.tokens) - least(2048 - len(t.tokens), len(c.tokens)) + 1,
                               len(c.tokens)) END AS context
        FROM tok t JOIN nn ON nn.example_id = t.example_id JOIN tok c ON c.example_id = nn.nn_id)"""

WHOLE_CTX = """ctx AS (SELECT nn.example_id, nn.nn_id, c.tokens AS context
        FROM nn JOIN tok c ON c.example_id = nn.nn_id)"""

ONESHOT = f"""{NN},
{WHOLE_CTX},
os0 AS (SELECT tok.example_id, tok.n_prompt, coalesce(ctx.context, []::VARCHAR[]) AS context, tok.tokens
        FROM tok LEFT JOIN ctx ON ctx.example_id = tok.example_id),
os1 AS (SELECT example_id, len(context) AS nc, n_prompt, list_concat(context, tokens) AS seq,
               list_concat(context, list_slice(tokens, 1, n_prompt)) AS cache FROM os0),
osp AS (SELECT example_id, nc, n_prompt, seq, unnest(seq) AS token, generate_subscripts(seq, 1) - 1 AS i FROM os1),
orr AS (SELECT example_id, token, CAST(i - nc AS BIGINT) AS pos, CASE WHEN i > 0 THEN seq[i] END AS prev
        FROM osp WHERE i >= nc + n_prompt),
orr_cc AS (SELECT example_id, token, count(*) AS cc FROM (SELECT example_id, unnest(cache) AS token FROM os1)
           GROUP BY example_id, token),
orr_cl AS (SELECT example_id, CAST(len(cache) AS DOUBLE) AS clen FROM os1),
{nll_sql('no', 'orr', True)},
os_loss AS (SELECT tok.example_id, l.loss FROM tok LEFT JOIN
   (SELECT example_id, avg(nll) AS loss FROM no GROUP BY example_id) l ON l.example_id = tok.example_id),
miwv AS (SELECT c.example_id, CASE WHEN abs(o.loss - c.loss) < 1e-12 THEN 0.0 ELSE o.loss - c.loss END AS score FROM cl_loss c LEFT JOIN os_loss o
         ON c.example_id = o.example_id)"""

WARM = f"""wsel AS (SELECT example_id FROM tok
  QUALIFY row_number() OVER (ORDER BY {draw(42, 'warmup', 'example_id')}, example_id)
          <= greatest(1, least(count(*) OVER (), CAST(round_even(0.1 * count(*) OVER (), 0) AS BIGINT)))),
subx AS (SELECT example_id AS id, tokens FROM tok WHERE example_id IN (SELECT example_id FROM wsel)),
{lm_sql('subx', 's_')},
b_uni AS (SELECT token, sum(c) AS c FROM (SELECT * FROM uni UNION ALL SELECT * FROM s_uni) GROUP BY token),
b_bi AS (SELECT prev, token, sum(c) AS c FROM (SELECT * FROM bi UNION ALL SELECT * FROM s_bi) GROUP BY prev, token),
b_pre AS (SELECT prev, sum(c) AS c_pre FROM b_bi GROUP BY prev),
b_tot AS (SELECT sum(c)::DOUBLE AS T, count(*)::DOUBLE AS V FROM b_uni)"""


def topk_from(cte: str, budget: float, digits: int | None = None) -> str:
    k = (f"greatest(1, least((SELECT count(*) FROM {cte}), "
         f"CAST(round_even({float(budget)} * (SELECT count(*) FROM {cte}), 0) AS BIGINT)))")
    out = sig("score") if digits is None else f"round(score, {digits}) + 0.0"
    return f"""SELECT example_id, {out} AS score FROM {cte}
QUALIFY row_number() OVER (ORDER BY {sig('score')} DESC NULLS LAST, example_id) <= {k}"""


ORACLE.update({
    "fit_lm_counts": f"WITH {BG}, {lm_sql()} SELECT prev, token, c FROM bi",
    "token_nll": f"""{G_BASE}, {COND_ROWS}, {nll_sql('nc', 'cr', True)}
SELECT example_id, 'cond' AS variant, pos, round(nll, 9) AS nll FROM nc""",
    "response_loss": f"{G_BASE}, {COND_LOSS} SELECT example_id, round(loss, 9) AS loss FROM cl_loss",
    "direct_loss": f"{G_BASE}, {DIRECT_LOSS} SELECT example_id, round(loss, 9) AS loss FROM dl_loss",
    "per_sample_loss": f"""{G_BASE}, {COND_ROWS}, {nll_sql('nc', 'cr', True)}
SELECT tok.example_id, round(coalesce(l.s, 0.0) / greatest(coalesce(l.n, 0), 1), 9) AS loss FROM tok LEFT JOIN
  (SELECT example_id, sum(nll) AS s, count(*) AS n FROM nc GROUP BY example_id) l ON l.example_id = tok.example_id""",
    "perplexity": f"{G_BASE}, {COND_LOSS} SELECT example_id, round(exp(loss), 4) AS score FROM cl_loss",
    "select_ppl": f"{G_BASE}, {COND_LOSS}, pp AS (SELECT example_id, exp(loss) AS score FROM cl_loss)\n"
                  + topk_from("pp", 0.1, 4),
    "ifd_score": IFD + "\nSELECT example_id, round(score, 9) AS score FROM ifd",
    "select_ifd": IFD + """,
ifv AS (SELECT example_id, CASE WHEN score IS NOT NULL AND NOT isnan(score) AND score > 0 AND score < 1.0
                                THEN score END AS score FROM ifd)
""" + topk_from("ifv", 0.1),
    "lm_brief_experience": f"""{G_BASE}, {WARM}, {COND_ROWS}, {nll_sql('nc', 'cr', True, 'b_')}
SELECT tok.example_id, round(l.loss, 9) AS loss FROM tok LEFT JOIN
  (SELECT example_id, avg(nll) AS loss FROM nc GROUP BY example_id) l ON l.example_id = tok.example_id""",
    "one_shot_context": f"""{G_BASE}, {NN},
{CUT_CTX}
SELECT example_id, nn_id, CAST(len(context) AS BIGINT) AS n_context, array_to_string(context, ' ') AS context
FROM ctx""",
    "miwv_score": f"{G_BASE}, {COND_LOSS}, {ONESHOT}\nSELECT example_id, round(score, 9) AS score FROM miwv",
    "select_miwv": f"{G_BASE}, {COND_LOSS}, {ONESHOT}\n" + topk_from("miwv", 0.1),
})

# --- the model of order 3 -------------------------------------------------------

KN_COUNTS = f"""{BG},
kg AS (SELECT id, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS pos FROM bgx),
kt AS (SELECT coalesce(lag(token, 2) OVER o, '') AS prev2, coalesce(lag(token) OVER o, '') AS prev, token
       FROM kg WINDOW o AS (PARTITION BY id ORDER BY pos)),
k3 AS MATERIALIZED (SELECT prev2, prev, token, count(*) AS c FROM kt GROUP BY ALL),
k2 AS MATERIALIZED (SELECT prev, token, count(*) AS n FROM k3 GROUP BY ALL),
k1 AS MATERIALIZED (SELECT token, count(*) AS n FROM k2 GROUP BY ALL)"""


def _discount(table: str, count: str) -> str:
    return (f"(SELECT CASE WHEN sum(({count} = 1)::INT) > 0 AND sum(({count} = 2)::INT) > 0 THEN sum(({count} = 1)::INT)::DOUBLE "
            f"/ (sum(({count} = 1)::INT) + 2 * sum(({count} = 2)::INT)) ELSE 0.5 END FROM {table})")


EM_STEPS = 10
KN_EM = ",\n".join(
    f"e{k + 1} AS MATERIALIZED (SELECT avg(a * q / (a * q + (1.0 - a) * p)) AS a FROM kp CROSS JOIN e{k} WHERE clen > 0)"
    for k in range(EM_STEPS))

KN_NLL = f"""WITH {CHAT}, {WHOLE_TOK}, {KN_COUNTS}, {COND_ROWS},
kd AS MATERIALIZED (SELECT {_discount('k3', 'c')} AS d3, {_discount('k2', 'n')} AS d2, {_discount('k1', 'n')} AS d1,
       (SELECT sum(n) FROM k1)::DOUBLE AS t, (SELECT count(*) FROM k1)::DOUBLE AS v),
h3 AS (SELECT prev2, prev, sum(c)::DOUBLE AS total, count(*) AS types FROM k3 GROUP BY ALL),
h2 AS (SELECT prev, sum(n)::DOUBLE AS total, count(*) AS types FROM k2 GROUP BY ALL),
kr AS (SELECT example_id, token, CAST(i AS BIGINT) AS pos, CASE WHEN i > 0 THEN tokens[i] ELSE '' END AS prev,
       CASE WHEN i > 1 THEN tokens[i - 1] ELSE '' END AS prev2 FROM cp WHERE i >= n_prompt),
q1 AS (SELECT r.*, (greatest(coalesce(k1.n, 0) - d1, 0.0) + d1 * v / (v + 1.0)) / t AS p1
       FROM kr r CROSS JOIN kd LEFT JOIN k1 ON k1.token = r.token),
q2 AS (SELECT r.*, CASE WHEN h2.total IS NULL THEN p1
                        ELSE (greatest(coalesce(k2.n, 0) - d2, 0.0) + d2 * h2.types * p1) / h2.total END AS p2
       FROM q1 r CROSS JOIN kd LEFT JOIN h2 ON h2.prev = r.prev LEFT JOIN k2 ON k2.prev = r.prev AND k2.token = r.token),
q3 AS (SELECT r.*, CASE WHEN h3.total IS NULL THEN p2
                        ELSE (greatest(coalesce(k3.c, 0) - d3, 0.0) + d3 * h3.types * p2) / h3.total END AS p3
       FROM q2 r CROSS JOIN kd LEFT JOIN h3 ON h3.prev2 = r.prev2 AND h3.prev = r.prev
       LEFT JOIN k3 ON k3.prev2 = r.prev2 AND k3.prev = r.prev AND k3.token = r.token),
kp AS MATERIALIZED (SELECT r.example_id, r.pos, r.p3 AS p, cl.clen,
       CASE WHEN cl.clen > 0 THEN coalesce(cc.cc, 0)::DOUBLE / cl.clen ELSE 0.0 END AS q
       FROM q3 r JOIN cr_cl cl ON cl.example_id = r.example_id
       LEFT JOIN cr_cc cc ON cc.example_id = r.example_id AND cc.token = r.token),
e0 AS (SELECT 0.5::DOUBLE AS a),
{KN_EM},
kl AS (SELECT example_id, pos, -ln(CASE WHEN clen > 0 THEN (1.0 - coalesce(a, 0.0)) * p + coalesce(a, 0.0) * q ELSE p END) AS nll
       FROM kp CROSS JOIN e{EM_STEPS})"""

ORACLE.update({
    "kn_counts": f"""WITH {KN_COUNTS}
SELECT prev2, prev, token, c FROM k3 UNION ALL SELECT NULL, prev, token, n FROM k2
UNION ALL SELECT NULL, NULL, token, n FROM k1""",
    "kn_token_nll": KN_NLL + "\nSELECT example_id, 'cond' AS variant, pos, round(nll, 9) AS nll FROM kl",
    "select_ppl_kn": KN_NLL + """,
kx AS (SELECT tok.example_id, exp(l.loss) AS score FROM tok LEFT JOIN
  (SELECT example_id, avg(nll) AS loss FROM kl GROUP BY example_id) l ON l.example_id = tok.example_id)
""" + topk_from("kx", 0.1, 4),
})


# --- influence ------------------------------------------------------------------
from winnow.functions.hashing import sql_draw_key, sql_sign_bit  # noqa: E402

B1C, B2C = repr(1 - 0.9), repr(1 - 0.999)

INF_BASE = f"""WITH {EMB},
fx AS (SELECT example_id, split, list_concat(v, [1.0::DOUBLE]) AS x,
              CASE WHEN label < 5 THEN 1.0 ELSE 0.0 END AS y FROM es),
wd AS (SELECT i, avg(CASE WHEN y = 1.0 THEN xi END) - avg(CASE WHEN y = 0.0 THEN xi END) AS wi
       FROM (SELECT y, unnest(x) AS xi, generate_subscripts(x, 1) AS i FROM fx WHERE split = 'train') GROUP BY i),
wl AS (SELECT list(wi ORDER BY i) AS w FROM wd),
gp AS (SELECT example_id, split, x, y, 1.0 / (1.0 + exp(-list_dot_product(x, w))) AS p FROM fx CROSS JOIN wl),
gl AS (SELECT example_id, split, CAST(i - 1 AS BIGINT) AS dim, (p - y) * xi AS g FROM (
        SELECT example_id, split, p, y, unnest(x) AS xi, generate_subscripts(x, 1) AS i FROM gp)),
wdim AS (SELECT CAST(i - 1 AS BIGINT) AS dim, wi FROM wd),
ad AS (SELECT gl.example_id, gl.split, gl.dim,
         CASE WHEN gl.split = 'train' THEN
           (0.9 * (wdim.wi * 0.5) + {B1C} * gl.g) / (sqrt(0.999 * (wdim.wi * wdim.wi) + {B2C} * gl.g * gl.g) + 1e-8)
         ELSE gl.g END AS g
       FROM gl JOIN wdim ON gl.dim = wdim.dim),
rm AS (SELECT i, j, {sql_sign_bit(42, 'proj', 'i', 'j')} * {1.0 / 32 ** 0.5!r} AS r
       FROM range(65) t1(i) CROSS JOIN range(32) t2(j))"""


# Structured projection of 65 inputs (padded to 128) to 160 outputs: two signed copies.
HAD_SIGN = f"""(CASE WHEN (instr('0123456789abcdef', substr({sql_draw_key(42, "had-' || c || '", 'i', '0')},
    CAST(i // 4 + 1 AS BIGINT), 1)) - 1) >> CAST(3 - i % 4 AS INTEGER) & 1 = 0 THEN 1.0 ELSE -1.0 END)"""
HADAMARD = f""",
hs AS (SELECT c, i, {HAD_SIGN} AS sg FROM range(2) t1(c) CROSS JOIN range(65) t2(i)),
hk AS (SELECT c, i, row_number() OVER (PARTITION BY c ORDER BY {sql_draw_key(42, "coord-' || c || '", 'i')}) - 1 AS place
       FROM range(2) t1(c) CROSS JOIN range(128) t2(i)),
hm AS (SELECT hs.i, hk.c * 128 + hk.place AS j,
              hs.sg * (1 - 2 * (bit_count(CAST(hs.i & hk.i AS BIGINT)) % 2)) * {1.0 / 160 ** 0.5!r} AS r
       FROM hs JOIN hk ON hs.c = hk.c WHERE hk.c * 128 + hk.place < 160)"""


def _proj(src: str) -> str:
    return f"(SELECT s.example_id, s.split, rm.j AS dim, sum(s.g * rm.r) AS g FROM {src} s JOIN rm ON rm.i = s.dim GROUP BY s.example_id, s.split, rm.j)"


ORACLE.update({
    "example_gradients": INF_BASE + """
SELECT example_id, split, CAST(0 AS BIGINT) AS ckpt, dim, round(g, 9) AS value FROM gl""",
    "adam_transform": INF_BASE + """
SELECT example_id, split, CAST(0 AS BIGINT) AS ckpt, dim, round(g, 9) AS value FROM ad""",
    "random_projection": INF_BASE + f"""
SELECT example_id, split, CAST(0 AS BIGINT) AS ckpt, CAST(dim AS BIGINT) AS dim, round(g, 9) AS value
FROM {_proj("(SELECT * FROM gl WHERE split = 'train')")}""",
    "structured_projection": INF_BASE + HADAMARD + """
SELECT gl.example_id, gl.split, CAST(0 AS BIGINT) AS ckpt, CAST(hm.j AS BIGINT) AS dim, round(sum(gl.g * hm.r), 9) AS value
FROM gl JOIN hm ON hm.i = gl.dim WHERE gl.split = 'train' GROUP BY gl.example_id, gl.split, hm.j""",
    "checkpoint_weights": """WITH c AS (SELECT * FROM (VALUES (0, 2), (1, 4), (2, 6), (3, 8)) t(ckpt, step)),
l AS (SELECT ckpt, 0.05 * greatest(0.0, (8 - step) / 8.0) AS lr FROM c)
SELECT CAST(ckpt AS BIGINT) AS ckpt,
       round(CASE WHEN (SELECT sum(lr) FROM l) > 0 THEN lr / (SELECT sum(lr) FROM l)
                  ELSE 1.0 / (SELECT count(*) FROM l) END, 9) AS weight FROM l""",
    "influence_score": INF_BASE + f""",
pt AS {_proj("(SELECT * FROM ad WHERE split = 'train')")},
pv AS {_proj("(SELECT * FROM gl WHERE split = 'validation')")},
nt AS (SELECT example_id, sqrt(sum(g * g)) + 1e-10 AS n FROM pt GROUP BY example_id),
nv AS (SELECT example_id, sqrt(sum(g * g)) + 1e-10 AS n FROM pv GROUP BY example_id),
cv AS (SELECT pv.dim, avg(pv.g / nv.n) AS c FROM pv JOIN nv ON pv.example_id = nv.example_id GROUP BY pv.dim)
SELECT pt.example_id, round(sum(pt.g / nt.n * cv.c), 9) AS score
FROM pt JOIN nt ON pt.example_id = nt.example_id JOIN cv ON cv.dim = pt.dim GROUP BY pt.example_id""",
    "last_number": """SELECT doc_id AS example_id,
  rtrim(replace(regexp_extract_all(coalesce(text, ''), '-?\\d[\\d,]*\\.?\\d*')[-1], ',', ''), '.') AS num
FROM documents""",
    "exact_match_accuracy": """SELECT count(*) AS n,
  round(sum(CASE WHEN CAST(quality AS VARCHAR) IS NOT NULL
                  AND (CASE WHEN toxic = 1 THEN '0' ELSE '1' END) = CAST(quality AS VARCHAR) THEN 1 ELSE 0 END)
        / greatest(count(*), 1), 9) AS accuracy FROM labels""",
    "benchmark_examples": """SELECT item_id, 'Question: ' || text || chr(10) || 'Answer:' AS prompt,
  rtrim(replace(regexp_extract_all(coalesce(text, ''), '-?\\d[\\d,]*\\.?\\d*')[-1], ',', ''), '.') AS gold
FROM benchmark ORDER BY item_id""",
})

ORACLE.update({
    "compose_scorer_policy": ORACLE["policy_hard"],
    "run_selection": ORACLE["select_bm25"],
    "custom_selector": """SELECT doc_id AS example_id, round(CAST(length(text) AS DOUBLE), 9) + 0.0 AS score
FROM documents QUALIFY row_number() OVER (ORDER BY round(CAST(length(text) AS DOUBLE), 9) DESC, doc_id)
  <= greatest(1, least(count(*) OVER (), CAST(round_even(0.05 * count(*) OVER (), 0) AS BIGINT)))""",
    "custom_scorer": """SELECT doc_id AS example_id,
  CAST(length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS DOUBLE) + 1.0 AS score
FROM documents""",
    "stream_reweight": ORACLE["weights_embed"].split("ac AS (")[0] + """vr AS (
  SELECT DISTINCT doc_id // 8 // 5 * 5 AS version FROM documents),
ac AS (SELECT vr.version, pa.dim, avg(pa.value) AS c FROM vr JOIN pa ON pa.anchor_id // 4 <= vr.version
       GROUP BY vr.version, pa.dim),
ss AS (SELECT pp.example_id, sum(pp.value * ac.c) AS score FROM pp LEFT JOIN ac
       ON pp.dim = ac.dim AND ac.version = pp.example_id // 8 // 5 * 5 GROUP BY pp.example_id)
SELECT example_id // 8 AS step, example_id, round(score, 9) AS score,
       CASE WHEN score IS NOT NULL THEN round(""" + gate_sql("score") + """, 9) END AS weight FROM ss""",
})
