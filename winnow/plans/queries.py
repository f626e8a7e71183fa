"""The registered queries: one per operator, each ``(spark, sf_dir) -> DataFrame``.

Every query reads the driver's tables (or what Spark derives from them) in
full.  Computed columns carry the same names as in ``oracle.py``; scores are
rounded to 9 digits, the rounding used for ranking.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from winnow.functions.text import tokenize_alnum as alnum_expr
from winnow.operators import budget as bud
from winnow.operators import evaluate as ev
from winnow.operators import influence as inf
from winnow.operators import kneser_ney as kn
from winnow.operators import lexical as lex
from winnow.operators import lm as lmod
from winnow.operators import losses as ls
from winnow.operators import policies as pol
from winnow.operators import records as rec
from winnow.operators import reweight as rw
from winnow.operators import token_vectors as tv
from winnow.operators import vectors as vec
from winnow.operators import sampling as smp
from winnow.plans import selectors as selx
from winnow.session import materialize, read_table, scratch_path, store
from winnow.streaming import reweight_stream as rs
from winnow.sources import io
from winnow.sources import tables as tb

R9 = 9


def r9(c: str):
    return F.round(F.col(c), R9).alias(c)


def _corpus(spark, sf):
    return lex.tokenize_alnum(tb.examples(spark, sf))


def _queries(spark, sf):
    return tb.target(spark, sf).select(F.col("item_id").alias("query_id"),
                                       alnum_expr("text").alias("tokens"))


# --- E: lexical ---------------------------------------------------------------

def q_select_bm25(spark: SparkSession, sf: str) -> DataFrame:
    return lex.select_bm25(tb.examples(spark, sf), tb.target(spark, sf), budget=0.05)


def q_tokenize_alnum(spark, sf):
    t = _corpus(spark, sf)
    return t.select("example_id", F.size("tokens").cast("long").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"))


def q_tokenize_whitespace(spark, sf):
    t = lex.tokenize_whitespace(tb.examples(spark, sf))
    return t.select("example_id", F.size("tokens").cast("long").alias("n_tokens"),
                    F.array_join("tokens", " ").alias("tokens"))


def q_term_frequency(spark, sf):
    return lex.term_frequency(_corpus(spark, sf))


def q_doc_length_stats(spark, sf):
    s = lex.doc_length_stats(_corpus(spark, sf))
    return s.select("n_docs", r9("avgdl"))


def q_inverse_doc_frequency(spark, sf):
    c = _corpus(spark, sf)
    return lex.inverse_doc_frequency(lex.term_frequency(c), lex.doc_length_stats(c)) \
              .select("term", "df", r9("idf"))


def q_bm25_pairs(spark, sf):
    return lex.bm25_pairs(_corpus(spark, sf), _queries(spark, sf)).select(
        "query_id", "example_id", r9("score"))


def q_bm25_mean(spark, sf):
    return lex.bm25_mean(_corpus(spark, sf), _queries(spark, sf)).select("example_id", r9("score"))


def q_bm25_max(spark, sf):
    return lex.bm25_max(_corpus(spark, sf), _queries(spark, sf)).select("example_id", r9("score"))


def q_bm25_self(spark, sf):
    return lex.bm25_self(_corpus(spark, sf)).select("example_id", r9("score"))


def q_bm25_anchor(spark, sf):
    return lex.bm25_anchor(tb.examples(spark, sf),
                           tb.target(spark, sf).withColumnRenamed("item_id", "anchor_id")) \
              .select("example_id", r9("score"))


def q_standardize(spark, sf):
    s = lex.bm25_anchor(tb.examples(spark, sf),
                        tb.target(spark, sf).withColumnRenamed("item_id", "anchor_id"))
    return lex.standardize(s).select("example_id", r9("score"))


# --- D: budget and top-k --------------------------------------------------------

def _bm25_scores(spark, sf):
    return lex.bm25_mean(_corpus(spark, sf), _queries(spark, sf))


def q_budget_to_k(spark, sf):
    return bud.budget_to_k(tb.examples(spark, sf), 0.05)


def q_topk_by_score(spark, sf):
    return bud.topk_by_score(_bm25_scores(spark, sf), 0.1)


def q_materialize_subset(spark, sf):
    ex = tb.examples(spark, sf)
    sel = lex.select_bm25(ex, tb.target(spark, sf), budget=0.05)
    return bud.materialize_subset(ex, sel).select("example_id", "lang", "source")


def q_invalid_sink(spark, sf):
    ex = tb.examples(spark, sf)
    s = _bm25_scores(spark, sf).join(ex.select("example_id", "lang"), "example_id")
    s = bud.invalid_sink(s, F.col("lang") == "en")
    return bud.topk_by_score(s.select("example_id", "score"), 0.5)


def q_score_direction(spark, sf):
    s = bud.score_direction(_bm25_scores(spark, sf), "low")
    return bud.topk_by_score(s, 0.05)


def q_policy_hard(spark, sf):
    return bud.policy_hard(_bm25_scores(spark, sf), 0.05)


def q_select_all(spark, sf):
    return bud.select_all(tb.examples(spark, sf))


# --- B: record shaping ------------------------------------------------------------

def alpaca_raw(spark, sf):
    """Alpaca-shaped rows from documents: first line / other lines; non-English rows
    carry their source tag as the input."""
    d = read_table(spark, sf, "documents")
    first = F.substring_index("text", "\n", 1)
    return d.select(F.col("doc_id").alias("example_id"), first.alias("instruction"),
                    F.when(F.col("lang") == "en", F.lit(None)).otherwise(F.col("source")).alias("input"),
                    F.expr("substr(text, length(substring_index(text, '\\n', 1)) + 2)").alias("output"))


def sharegpt_raw(spark, sf):
    """ShareGPT-shaped rows from conversations (user -> human, assistant -> gpt)."""
    c = tb.conversations(spark, sf)
    frm = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt") \
           .otherwise(F.col("role"))
    g = c.groupBy(F.col("conv_id").alias("example_id")).agg(F.array_sort(F.collect_list(
        F.struct(F.col("turn").alias("t"), frm.alias("from"), F.col("text").alias("value")))).alias("_c"))
    return g.select("example_id", F.transform("_c", lambda x: F.struct(
        x["from"].alias("from"), x["value"].alias("value"))).alias("conversations"))


def chat_records(spark, sf):
    return rec.chat_to_record(tb.conversations(spark, sf))


def q_alpaca_record(spark, sf):
    return rec.alpaca_record(alpaca_raw(spark, sf))


def q_chat_to_record(spark, sf):
    return chat_records(spark, sf)


def q_sharegpt_first_pair(spark, sf):
    return rec.sharegpt_first_pair(sharegpt_raw(spark, sf))


def q_evol_record(spark, sf):
    chat = sharegpt_raw(spark, sf).select(
        F.lit("chat").alias("origin"), "example_id", "conversations",
        F.lit(None).cast("string").alias("instruction"), F.lit(None).cast("string").alias("output"))
    docs = alpaca_raw(spark, sf).select(
        F.lit("doc").alias("origin"), "example_id",
        F.array().cast("array<struct<from:string,value:string>>").alias("conversations"),
        "instruction", "output")
    return rec.evol_record(chat.unionByName(docs), keep=["origin"])


def q_format_prompt(spark, sf):
    return rec.format_prompt(rec.alpaca_record(alpaca_raw(spark, sf))).select("example_id", "text")


def _tok(spark, sf):
    return rec.tokenize_mask(chat_records(spark, sf))


def _whole_tok(spark, sf):
    return rec.tokenize_mask(chat_records(spark, sf), max_length=None)


def q_tokenize_mask(spark, sf):
    t = _tok(spark, sf)
    return t.select("example_id", F.size("tokens").cast("long").alias("n_tokens"), "n_prompt",
                    F.array_join("tokens", " ").alias("tokens"))


def q_response_tokens(spark, sf):
    r = rec.response_tokens(_whole_tok(spark, sf))
    return r.select("example_id", F.size("response").cast("long").alias("n_response"),
                    F.array_join("response", " ").alias("response"))


def q_scorable_flag(spark, sf):
    return rec.scorable_flag(_tok(spark, sf))


# --- A: sources and sinks ------------------------------------------------------------

CHAT_NAMES = ["dolly", "oasst1"]


def q_read_records(spark, sf):
    return io.read_records(spark, f"{sf}/documents.parquet")


def q_read_chat_sources(spark, sf):
    base = scratch_path(spark, "chat-sources")
    msgs = rec.turns_to_messages(tb.conversations(spark, sf))
    tagged = msgs.withColumn("dataset", F.when(F.col("example_id") % 2 == 0, CHAT_NAMES[0])
                             .otherwise(CHAT_NAMES[1]))
    for i, name in enumerate(CHAT_NAMES):
        where = f"{base}/{name}_data.jsonl" if i == 0 else f"{base}/{name}/{name}_data.jsonl"
        io.write_jsonl(tagged.filter(F.col("dataset") == name)
                       .select("dataset", F.col("example_id").cast("string").alias("id"), "messages"),
                       where)
    raw = io.read_chat_sources(spark, base, CHAT_NAMES) \
            .withColumn("example_id", F.col("id").cast("long"))
    return rec.messages_to_record(raw, keep=["dataset"])


def q_write_jsonl(spark, sf):
    path = scratch_path(spark, "records") + "/alpaca.jsonl"
    io.write_jsonl(rec.alpaca_record(alpaca_raw(spark, sf)), path)
    schema = io.RECORD_SCHEMA.add("example_id", "long")
    return io.read_records(spark, path, schema=schema)


def q_build_if_missing(spark, sf):
    base = scratch_path(spark, "built")
    key = "chat-records/seed=42/pct=1.0"
    io.build_if_missing(spark, base, key, lambda: chat_records(spark, sf))
    return io.build_if_missing(spark, base, key, lambda: chat_records(spark, sf))


def q_selection_manifest(spark, sf):
    sel = lex.select_bm25(tb.examples(spark, sf), tb.target(spark, sf), budget=0.05)
    return io.selection_manifest(sel, "bm25", 0.05, ids_path=scratch_path(spark, "selected-ids"))


def q_dataset_sizes(spark, sf):
    sp = smp.train_val_split(tb.examples(spark, sf).select("example_id"), 0.05, seed=42)
    return io.dataset_sizes(sp.filter(F.col("split") == "train"),
                            sp.filter(F.col("split") == "validation"))


# --- C: sampling ----------------------------------------------------------------

def q_subsample_fraction(spark, sf):
    return smp.subsample_fraction(tb.examples(spark, sf).select("example_id"), 0.3, seed=3)


def _sources(spark, sf):
    return tb.examples(spark, sf).select(F.col("source").alias("dataset"), "example_id")


def q_mix_sources(spark, sf):
    return smp.mix_sources(_sources(spark, sf), 0.5, seed=3)


def q_mixture_stats(spark, sf):
    src = _sources(spark, sf)
    return smp.mixture_stats(src, smp.mix_sources(src, 0.5, seed=3))


def q_train_val_split(spark, sf):
    return smp.train_val_split(tb.examples(spark, sf).select("example_id"), 0.05, seed=42)


def q_select_random(spark, sf):
    return smp.select_random(tb.examples(spark, sf), 0.05, seed=42)


def q_warmup_subset(spark, sf):
    return smp.warmup_subset(tb.examples(spark, sf), 0.01, seed=42, rounding="even")


def q_cluster_round_robin(spark, sf):
    return smp.cluster_round_robin(tb.vectors(spark, sf).select("example_id", "label"), 50, seed=42)


def q_query_sample(spark, sf):
    return smp.query_sample(tb.examples(spark, sf), 256, seed=42)


# --- F: vectors ------------------------------------------------------------------

def _ws_docs(spark, sf):
    return lex.tokenize_whitespace(tb.examples(spark, sf))


def _ws_anchors(spark, sf):
    return lex.tokenize_whitespace(tb.target(spark, sf).withColumnRenamed("item_id", "anchor_id"),
                                   id_col="anchor_id")


def _long(vecs, id_col="example_id"):
    return vec.long_form(vecs, id_col).select(id_col, "dim", r9("value"))


def _emb_split(spark, sf):
    """Embeddings with a hash-drawn validation split (C4, 5%), written once: the
    train and validation branches of a query both read it."""
    v = tb.vectors(spark, sf)
    sp = smp.train_val_split(v.select("example_id"), 0.05, seed=42)
    return materialize(v.join(sp, "example_id"))


def _emb_parts(spark, sf):
    """(train, validation) embeddings from one written split."""
    split = _emb_split(spark, sf)
    cols = ["example_id", "vec", "label"]
    return (split.filter(F.col("split") == "train").select(*cols),
            split.filter(F.col("split") == "validation").select(*cols))


def _emb_train(spark, sf):
    return _emb_split(spark, sf).filter(F.col("split") == "train").select("example_id", "vec", "label")


def _emb_val(spark, sf):
    return _emb_split(spark, sf).filter(F.col("split") == "validation").select("example_id", "vec", "label")


def q_encode_mean_pool(spark, sf):
    return _long(vec.encode_mean_pool(_ws_docs(spark, sf)))


def q_token_ppmi(spark, sf):
    return tv.token_ppmi(_ws_docs(spark, sf), digits=R9)


def q_learn_token_vectors(spark, sf):
    vecs = tv.learn_token_vectors(_ws_docs(spark, sf))
    return vecs.select("token", F.posexplode("vec").alias("dim", "value"))


def q_encode_learned_pool(spark, sf):
    docs = materialize(_ws_docs(spark, sf).select("example_id", "tokens"))
    return _long(vec.encode_mean_pool(docs, token_vecs=tv.learn_token_vectors(docs)))


def q_encode_position_pool(spark, sf):
    return _long(vec.encode_position_pool(_ws_docs(spark, sf)))


def q_l2_normalize(spark, sf):
    return _long(vec.l2_normalize(tb.vectors(spark, sf).select("example_id", "vec")))


def q_centroid(spark, sf):
    c = vec.centroid(tb.vectors(spark, sf))
    return c.select(F.posexplode("vec").alias("dim", "value")).select(
        F.col("dim").cast("long").alias("dim"), r9("value"))


def q_cosine_to_centroid(spark, sf):
    train, val = _emb_parts(spark, sf)
    return vec.cosine_to_centroid(train, val).select("example_id", r9("score"))


def q_select_embedding(spark, sf):
    train, val = _emb_parts(spark, sf)
    return vec.select_embedding(train, val, budget=0.05, keep="near")


def q_anchor_mean_cosine(spark, sf):
    tr, va = _emb_parts(spark, sf)
    train, anchors = vec.l2_normalize(tr, 1e-8), vec.l2_normalize(va, 1e-8)
    return vec.anchor_mean_cosine(train, anchors).select("example_id", r9("score"))


def q_nearest_neighbor(spark, sf):
    return vec.nearest_neighbor(tb.vectors(spark, sf), mode="index")


def q_pairwise_similarity_agg(spark, sf):
    train, val = _emb_parts(spark, sf)
    mean = vec.pairwise_similarity_agg(train, val, "mean").withColumnRenamed("score", "mean_sim")
    mx = vec.pairwise_similarity_agg(train, val, "max", block=128).withColumnRenamed("score", "max_sim")
    return mean.join(mx, "example_id").select("example_id", r9("mean_sim"), r9("max_sim"))


def q_kmeans_labels(spark, sf):
    return vec.kmeans_labels(tb.vectors(spark, sf), k=10, seed=42)


# --- I: reweighting -------------------------------------------------------------

def q_sigmoid_gate(spark, sf):
    return rw.sigmoid_gate(_bm25_scores(spark, sf), tau=1.0).select("example_id", r9("weight"))


def q_policy_reweight(spark, sf):
    s = lex.standardize(_bm25_scores(spark, sf))
    return rw.policy_reweight(s, tau=0.5, w_min=0.05, w_max=0.9).select("example_id", r9("weight"))


def q_weights_bm25(spark, sf):
    w = rw.weights_bm25(tb.examples(spark, sf),
                        tb.target(spark, sf).withColumnRenamed("item_id", "anchor_id"),
                        standardize_signal=True)
    return w.select("example_id", r9("score"), r9("weight"))


def q_weights_embed(spark, sf):
    w = rw.weights_embed(_ws_docs(spark, sf), _ws_anchors(spark, sf))
    return w.select("example_id", r9("score"), r9("weight"))


def _event_batches(spark, sf):
    """Training-loop view of events: batches of 8 in event order; loss = value."""
    e = read_table(spark, sf, "events")
    return e.select(F.col("event_id").alias("example_id"),
                    F.floor(F.col("event_id") / 8).cast("long").alias("batch_id"),
                    F.col("value").alias("loss"))


def q_combine_weighted_loss(spark, sf):
    b = _event_batches(spark, sf)
    w = rw.sigmoid_gate(read_table(spark, sf, "events").select(
        F.col("event_id").alias("example_id"), (F.col("value") / 10.0 - 1.0).alias("score")))
    return rw.combine_weighted_loss(b, w, "batch_id", "zsum").select("batch_id", r9("loss"))


def q_anchor_refresh(spark, sf):
    steps = _event_batches(spark, sf).select(F.col("batch_id").alias("step")).distinct()
    # a vector becomes an anchor at the step that its id names
    anchors = vec.l2_normalize(_emb_val(spark, sf), 1e-8).withColumn("effective_step", F.col("example_id"))
    a = rw.anchor_refresh(steps, anchors, interval=50)
    return a.select("step", "version", F.posexplode_outer("vec").alias("dim", "value")).select(
        "step", "version", F.col("dim").cast("long").alias("dim"), r9("value"))


def q_thread_row_id(spark, sf):
    return rw.thread_row_id(tb.examples(spark, sf), ["text"])


# --- G: language-model losses ---------------------------------------------------

def _bg_lm(spark, sf):
    """Count LM on the whole documents table (whitespace tokens)."""
    return lmod.fit_lm_counts(_ws_docs(spark, sf))


def _prompt_vecs(tok):
    return vec.encode_mean_pool(lex.tokenize_whitespace(tok.select("example_id", "text")))


def q_fit_lm_counts(spark, sf):
    return _bg_lm(spark, sf).bi


def q_token_nll(spark, sf):
    return lmod.token_nll(store(_whole_tok(spark, sf)), _bg_lm(spark, sf), "cond").select(
        "example_id", "variant", "pos", r9("nll"))


def _kn(spark, sf):
    """Counts of the documents; the records are no part of them, so their tokens give the cache weight.
    The records' probabilities are looked up once, for EM and for the losses."""
    tok = materialize(_whole_tok(spark, sf))
    lm = kn.fit_kneser_ney(_ws_docs(spark, sf))
    scored = store(kn.scored_histories(tok, lm))
    return tok, kn.fit_cache_weight(tok, lm, scored=scored), scored


def q_kn_counts(spark, sf):
    m = kn.fit_kneser_ney(_ws_docs(spark, sf))
    none = F.lit(None).cast("string")
    return (m.tri.unionByName(m.bi.select(none.alias("prev2"), "prev", "token", F.col("n").alias("c")))
            .unionByName(m.uni.select(none.alias("prev2"), none.alias("prev"), "token", F.col("n").alias("c"))))


def q_kn_token_nll(spark, sf):
    tok, lm, scored = _kn(spark, sf)
    return kn.kn_token_nll(tok, lm, scored=scored).select("example_id", "variant", "pos", r9("nll"))


def q_select_ppl_kn(spark, sf):
    tok, lm, scored = _kn(spark, sf)
    return kn.select_ppl_kn(tok, lm, budget=0.1, keep="high", scored=scored)


def q_response_loss(spark, sf):
    tok = store(_whole_tok(spark, sf))
    return ls.response_loss(lmod.token_nll(tok, _bg_lm(spark, sf), "cond"), tok).select(
        "example_id", r9("loss"))


def q_direct_loss(spark, sf):
    tok = store(_whole_tok(spark, sf))
    return ls.direct_loss(lmod.token_nll(tok, _bg_lm(spark, sf), "direct"), tok).select(
        "example_id", r9("loss"))


def q_per_sample_loss(spark, sf):
    tok = store(_whole_tok(spark, sf))
    return ls.per_sample_loss(lmod.token_nll(tok, _bg_lm(spark, sf), "cond"), tok).select(
        "example_id", r9("loss"))


def q_perplexity(spark, sf):
    tok = store(_whole_tok(spark, sf))
    loss = ls.response_loss(lmod.token_nll(tok, _bg_lm(spark, sf), "cond"), tok)
    return ls.perplexity(loss).select("example_id", F.round("score", 4).alias("score"))


def q_select_ppl(spark, sf):
    return ls.select_ppl(_whole_tok(spark, sf), _bg_lm(spark, sf), budget=0.1, keep="high")


def q_ifd_score(spark, sf):
    return ls.ifd_scores(_whole_tok(spark, sf), _bg_lm(spark, sf)).select("example_id", r9("score"))


def q_select_ifd(spark, sf):
    return ls.select_ifd(_whole_tok(spark, sf), _bg_lm(spark, sf), budget=0.1, ifd_max=1.0)


def q_select_ifd_warm(spark, sf):
    return ls.select_ifd_warm(_whole_tok(spark, sf), _bg_lm(spark, sf), budget=0.1, ifd_max=1.0)


def q_lm_brief_experience(spark, sf):
    tok = store(_whole_tok(spark, sf))
    sel = smp.warmup_subset(tok, 0.1, seed=42, rounding="even")
    brief = lmod.lm_brief_experience(_bg_lm(spark, sf), tok, sel)
    return ls.response_loss(lmod.token_nll(tok, brief, "cond"), tok).select("example_id", r9("loss"))


def q_one_shot_context(spark, sf):
    tok = _whole_tok(spark, sf)
    nn = vec.nearest_neighbor(_prompt_vecs(tok), mode="index")
    ctx = ls.one_shot_context(tok, nn, max_length=2048)
    return ctx.select("example_id", "nn_id", F.size("context").cast("long").alias("n_context"),
                      F.array_join("context", " ").alias("context"))


def q_miwv_score(spark, sf):
    tok = _whole_tok(spark, sf)
    return ls.miwv_scores(tok, _prompt_vecs(tok), _bg_lm(spark, sf)).select("example_id", r9("score"))


def q_select_miwv(spark, sf):
    tok = _whole_tok(spark, sf)
    return ls.select_miwv(tok, _prompt_vecs(tok), _bg_lm(spark, sf), budget=0.1)


# --- H: gradient influence ---------------------------------------------------------

def _vy(df):
    return df.withColumn("y", (F.col("label") < 5).cast("double"))


def _md_ckpt(spark, sf):
    return materialize(inf.mean_difference_checkpoint(_vy(_emb_train(spark, sf))))


def _grads_long(g):
    return g.select("example_id", "split", F.col("ckpt").cast("long").alias("ckpt"),
                    F.posexplode("grad").alias("dim", "value")) \
            .select("example_id", "split", "ckpt", F.col("dim").cast("long").alias("dim"), r9("value"))


def _md_grads(spark, sf):
    split = _emb_split(spark, sf)
    train = _vy(split.filter(F.col("split") == "train").select("example_id", "vec", "label"))
    val = _vy(split.filter(F.col("split") == "validation").select("example_id", "vec", "label"))
    ck = materialize(inf.mean_difference_checkpoint(train))
    return ck, inf.example_gradients(train, ck, "train"), inf.example_gradients(val, ck, "validation")


def q_warmup_checkpoints(spark, sf):
    v = _vy(_emb_train(spark, sf))
    sel = smp.warmup_subset(v, 0.05, seed=42, rounding="trunc")
    return inf.warmup_checkpoints(v, sel)


def q_example_gradients(spark, sf):
    _, tg, vg = _md_grads(spark, sf)
    return _grads_long(tg.unionByName(vg))


def q_adam_transform(spark, sf):
    ck, tg, vg = _md_grads(spark, sf)
    return _grads_long(inf.adam_transform(tg.unionByName(vg), ck))


def q_random_projection(spark, sf):
    _, tg, _ = _md_grads(spark, sf)
    return _grads_long(inf.random_projection(tg, p=32, seed=42))


def q_structured_projection(spark, sf):
    _, tg, _ = _md_grads(spark, sf)
    return _grads_long(inf.structured_projection(tg, p=160, seed=42))


def q_checkpoint_weights(spark, sf):
    v = _vy(_emb_train(spark, sf))
    sel = smp.warmup_subset(v, 0.05, seed=42, rounding="trunc")
    ck = inf.warmup_checkpoints(v, sel, steps=8, lr=0.05, num_checkpoints=4)
    return inf.checkpoint_weights(ck).select(F.col("ckpt").cast("long").alias("ckpt"), r9("weight"))


def q_influence_score(spark, sf):
    ck, tg, vg = _md_grads(spark, sf)
    t = inf.random_projection(inf.adam_transform(tg, ck), p=32, seed=42)
    v = inf.random_projection(vg, p=32, seed=42)
    return inf.influence_score(t, v, inf.checkpoint_weights(ck), "mean").select("example_id", r9("score"))


def q_select_less(spark, sf):
    train, val = _emb_parts(spark, sf)
    return inf.select_less(_vy(train), _vy(val), budget=0.05)


# --- J: evaluation ---------------------------------------------------------------

def q_last_number(spark, sf):
    return ev.last_number(tb.examples(spark, sf))


def q_exact_match_accuracy(spark, sf):
    lab = read_table(spark, sf, "labels")
    preds = lab.select(F.when(F.col("toxic") == 1, "0").otherwise("1").alias("prediction"),
                       F.col("quality").cast("string").alias("gold"))
    return ev.exact_match_accuracy(preds).select("n", r9("accuracy"))


def q_benchmark_examples(spark, sf):
    b = tb.target(spark, sf).select("item_id", F.col("text").alias("question"), F.col("text").alias("answer"))
    return ev.benchmark_examples(b, limit=None)


# --- D8-D10: policies ------------------------------------------------------------

def _md_val_gradient(spark, sf):
    _, tg, vg = _md_grads(spark, sf)
    g = vg.select(F.posexplode("grad").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("x"))
    gval = g.agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("_s")) \
            .select(F.transform("_s", lambda e: e["x"]).alias("gval"))
    return tg, gval


def q_policy_diversity(spark, sf):
    train, val = _emb_parts(spark, sf)
    scores = vec.cosine_to_centroid(train, val)
    return pol.policy_diversity(scores, train, budget=0.05, seed=42)


def q_policy_greats(spark, sf):
    tg, gval = _md_val_gradient(spark, sf)
    grads = tg.select(F.floor(F.col("example_id") / 16).cast("long").alias("batch_id"), "example_id", "grad")
    return pol.policy_greats(grads, gval, k=4, eta=0.1)


def q_compose_scorer_policy(spark, sf):
    return selx.compose(tb.examples(spark, sf), tb.target(spark, sf), scorer="bm25", policy="hard",
                        budget=0.05)


# --- K: UDF surface -------------------------------------------------------------

def q_run_selection(spark, sf):
    return selx.run_selection(tb.examples(spark, sf), tb.target(spark, sf), method="bm25", budget=0.05)


def _longest(ex, val, **_):
    return ex.select("example_id", F.length("text").cast("double").alias("score"))


def q_custom_selector(spark, sf):
    selx.register_selector("longest", _longest)
    return selx.run_selection(tb.examples(spark, sf), None, method="longest", budget=0.05)


def _line_count_scorer(pdf):
    import pandas as pd
    return pd.DataFrame({"example_id": pdf["example_id"],
                         "score": pdf["text"].fillna("").str.count("\n").astype("float64") + 1.0})


def q_custom_scorer(spark, sf):
    selx.register_scorer("lines", _line_count_scorer, "example_id long, score double")
    return selx.score_with("lines", tb.examples(spark, sf).select("example_id", "text"))


# --- I6-I7: streaming -------------------------------------------------------------

def _quarters(df, order):
    last = df.agg(F.max(order)).first()[0] or 0
    return [last * q // 4 for q in (1, 2, 3)]


def _in_rounds(spark, feeds, bounds, start):
    """The ``feeds`` (table, order) arrive in rounds: rows up to each bound of their order, then the rest.

    Every task of a table writes its own file of a round; then ``start(streams)`` takes all that is new as one
    micro-batch and ends.  The next round goes on from the checkpoint.
    """
    folders = [scratch_path(spark, "stream-in") for _ in feeds]
    low = None
    for high in [*bounds, None]:
        for (df, order), folder in zip(feeds, folders):
            part = df if low is None else df.filter(order > low)
            part = part if high is None else part.filter(order <= high)
            part.write.mode("append").parquet(folder)
        start(*(spark.readStream.schema(df.schema).parquet(folder) for (df, _), folder in zip(feeds, folders))).awaitTermination()
        low = high


def q_stream_reweight(spark, sf):
    """Batches of 8 documents as steps; anchors become effective, four a step, while they run."""
    docs = tb.examples(spark, sf).select("example_id", F.expr("example_id div 8").alias("step"), "text")
    anchors = tb.target(spark, sf).select(F.col("item_id").alias("anchor_id"),
                                          F.expr("item_id div 4").alias("effective_step"), "text")
    sink, ckpt = scratch_path(spark, "reweight-out"), scratch_path(spark, "reweight-ckpt")
    _in_rounds(spark, [(docs, F.col("step")), (anchors, F.col("effective_step"))], _quarters(docs, F.col("step")),
               lambda ex, an: rs.stream_reweight(ex, an, sink, ckpt, interval=5,
                                                 spread=spark.sparkContext.defaultParallelism))
    return spark.read.parquet(sink).select("step", "example_id", r9("score"), r9("weight"))


def q_stream_greats(spark, sf):
    tg, gval = _md_val_gradient(spark, sf)
    gval = materialize(gval)                                           # read again by every round
    rows = tg.select("example_id", "grad")
    end = spark.createDataFrame([(2**62, None)], rows.schema)          # flushes what waits for a full batch
    sink, ckpt = scratch_path(spark, "greats-out"), scratch_path(spark, "greats-ckpt")
    _in_rounds(spark, [(rows.unionByName(end), F.col("example_id"))], _quarters(rows, F.col("example_id")),
               lambda grads: rs.stream_greats(grads, gval, sink, ckpt, k=4, eta=0.1))
    return spark.read.parquet(sink).select("batch_id", "example_id", "rank")


QUERIES = {
    "select_bm25": q_select_bm25,
    "tokenize_alnum": q_tokenize_alnum,
    "tokenize_whitespace": q_tokenize_whitespace,
    "term_frequency": q_term_frequency,
    "doc_length_stats": q_doc_length_stats,
    "inverse_doc_frequency": q_inverse_doc_frequency,
    "bm25_pairs": q_bm25_pairs,
    "bm25_mean": q_bm25_mean,
    "bm25_max": q_bm25_max,
    "bm25_self": q_bm25_self,
    "bm25_anchor": q_bm25_anchor,
    "standardize": q_standardize,
    "budget_to_k": q_budget_to_k,
    "topk_by_score": q_topk_by_score,
    "materialize_subset": q_materialize_subset,
    "invalid_sink": q_invalid_sink,
    "score_direction": q_score_direction,
    "policy_hard": q_policy_hard,
    "select_all": q_select_all,
    "alpaca_record": q_alpaca_record,
    "chat_to_record": q_chat_to_record,
    "sharegpt_first_pair": q_sharegpt_first_pair,
    "evol_record": q_evol_record,
    "format_prompt": q_format_prompt,
    "tokenize_mask": q_tokenize_mask,
    "response_tokens": q_response_tokens,
    "scorable_flag": q_scorable_flag,
    "read_records": q_read_records,
    "read_chat_sources": q_read_chat_sources,
    "write_jsonl": q_write_jsonl,
    "build_if_missing": q_build_if_missing,
    "selection_manifest": q_selection_manifest,
    "dataset_sizes": q_dataset_sizes,
    "subsample_fraction": q_subsample_fraction,
    "mix_sources": q_mix_sources,
    "mixture_stats": q_mixture_stats,
    "train_val_split": q_train_val_split,
    "select_random": q_select_random,
    "warmup_subset": q_warmup_subset,
    "cluster_round_robin": q_cluster_round_robin,
    "query_sample": q_query_sample,
    "encode_mean_pool": q_encode_mean_pool,
    "encode_position_pool": q_encode_position_pool,
    "token_ppmi": q_token_ppmi,
    "learn_token_vectors": q_learn_token_vectors,
    "encode_learned_pool": q_encode_learned_pool,
    "l2_normalize": q_l2_normalize,
    "centroid": q_centroid,
    "cosine_to_centroid": q_cosine_to_centroid,
    "select_embedding": q_select_embedding,
    "anchor_mean_cosine": q_anchor_mean_cosine,
    "nearest_neighbor": q_nearest_neighbor,
    "pairwise_similarity_agg": q_pairwise_similarity_agg,
    "kmeans_labels": q_kmeans_labels,
    "sigmoid_gate": q_sigmoid_gate,
    "policy_reweight": q_policy_reweight,
    "weights_bm25": q_weights_bm25,
    "weights_embed": q_weights_embed,
    "combine_weighted_loss": q_combine_weighted_loss,
    "anchor_refresh": q_anchor_refresh,
    "thread_row_id": q_thread_row_id,
    "fit_lm_counts": q_fit_lm_counts,
    "token_nll": q_token_nll,
    "response_loss": q_response_loss,
    "direct_loss": q_direct_loss,
    "per_sample_loss": q_per_sample_loss,
    "perplexity": q_perplexity,
    "select_ppl": q_select_ppl,
    "kn_counts": q_kn_counts,
    "kn_token_nll": q_kn_token_nll,
    "select_ppl_kn": q_select_ppl_kn,
    "ifd_score": q_ifd_score,
    "select_ifd": q_select_ifd,
    "select_ifd_warm": q_select_ifd_warm,
    "lm_brief_experience": q_lm_brief_experience,
    "one_shot_context": q_one_shot_context,
    "miwv_score": q_miwv_score,
    "select_miwv": q_select_miwv,
    "warmup_checkpoints": q_warmup_checkpoints,
    "example_gradients": q_example_gradients,
    "adam_transform": q_adam_transform,
    "random_projection": q_random_projection,
    "structured_projection": q_structured_projection,
    "checkpoint_weights": q_checkpoint_weights,
    "influence_score": q_influence_score,
    "select_less": q_select_less,
    "last_number": q_last_number,
    "exact_match_accuracy": q_exact_match_accuracy,
    "benchmark_examples": q_benchmark_examples,
    "policy_diversity": q_policy_diversity,
    "policy_greats": q_policy_greats,
    "compose_scorer_policy": q_compose_scorer_policy,
    "run_selection": q_run_selection,
    "custom_selector": q_custom_selector,
    "custom_scorer": q_custom_scorer,
    "stream_reweight": q_stream_reweight,
    "stream_greats": q_stream_greats,
}
