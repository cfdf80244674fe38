"""Similarity, leakage, retrieval and ranking queries (J, W, N rows)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.functions import vectors as V
from spindrift.operators import retrieval as R
from spindrift.operators import similarity as S
from spindrift.plans.registry import query
from spindrift.plans.text import _TOK, _content_sql, _sql_list
from spindrift.runtime import table


def _grams(t, key, n, where="text is not null"):
    return f"(select distinct {key}, array_to_string(w[i:i+{n - 1}],' ') gram from (select {key}, w, unnest(case when len(w)>={n} then range(1,len(w)-{n - 2}) else [] end) i from (select {key}, {_TOK} w from {t} where {where})))"


@query("j11_protected_containment", "J11 T9 T18", f"""
with a as {_grams('eval_items', 'item_id', 5)}, b as {_grams('documents', 'doc_id', 5)}, t as (select item_id, count(*) total from a group by 1),
s as (select item_id, doc_id, count(*) shared from a join b using(gram) group by all)
select item_id, doc_id, shared, total, round(shared/total::double,6) as containment from s join t using(item_id) where shared/total::double >= 0.35""")
def protected_containment(s, d):
    return S.gram_containment(table(s, d, "eval_items"), table(s, d, "documents"), 5, 0.35)


@query("t19_shared_runs", "T19", f"select distinct item_id, doc_id from {_grams('eval_items', 'item_id', 8)} join {_grams('documents', 'doc_id', 8)} using(gram)")
def shared_runs(s, d):
    return S.shared_runs(table(s, d, "eval_items"), table(s, d, "documents"))


def _placed(t, key, n):
    return f"(select {key}, i, array_to_string(w[i:i+{n - 1}],' ') gram from (select {key}, w, unnest(case when len(w)>={n} then range(1,len(w)-{n - 2}) else [] end) i from (select {key}, {_TOK} w from (select distinct {key}, text from {t} where text is not null))))"


@query("t19_run_lengths", "T19", f"""
with m as (select item_id, doc_id, a.i, a.i-b.i d, b.i j from {_placed('eval_items', 'item_id', 8)} a join {_placed('documents', 'doc_id', 8)} b using(gram)),
r as (select item_id, doc_id, d, i-row_number() over(partition by item_id, doc_id, d order by i) g from m), c as (select item_id, doc_id, count(*) n from r group by item_id, doc_id, d, g)
select item_id, doc_id, (max(n)+7)::bigint as run from c group by all""")
def run_lengths(s, d):
    return S.longest_runs(table(s, d, "eval_items"), table(s, d, "documents"), 8)


@query("j08_banded_pairs", "J8 T11", f"""
with w as (select doc_id, {_content_sql('text', X.VALIDATION_STOPWORDS)} s from documents where text is not null),
p as (select a.doc_id a, b.doc_id b, a.s sa, b.s sb from w a join w b on b.doc_id>a.doc_id and b.doc_id-a.doc_id<=39),
j as (select a, b, case when len(sa)=0 and len(sb)=0 then 1.0 else len(list_intersect(sa,sb))/(len(sa)+len(sb)-len(list_intersect(sa,sb)))::double end l from p)
select a, b, round(l,6) as likeness from j where l>=0.5""")
def banded(s, d):
    return S.banded_pairs(table(s, d, "documents").filter("text is not null"), "doc_id", 39, 0.5)


@query("j09_nearest_vectors", "J9 N1 N2 W2", """
with q as (select vec_id q, embedding e from embeddings where vec_id%20=0),
x as (select q.q, e.vec_id v, list_sum(list_transform(list_zip(q.e, e.embedding), z -> pow(z[1]::double-z[2]::double,2))) dist from q join embeddings e on e.vec_id<>q.q)
select q, v, round(dist,5) as dist from x qualify row_number() over(partition by q order by round(dist,5), v)<=5""")
def nearest(s, d):
    e = table(s, d, "embeddings")
    return R.nearest_vectors(e.filter("vec_id % 20 = 0"), e, 5)


@query("w01_privacy_rerank", "W1 N4", """
with q as (select vec_id q, embedding e from embeddings where vec_id%20=0),
x as (select q.q, e.vec_id v, round(list_dot_product(q.e::double[], e.embedding::double[]),6) c from q join embeddings e on e.vec_id<>q.q qualify row_number() over(partition by q.q order by c desc, v)<=8),
m as (select *, exp((c-max(c) over(partition by q))/0.07) ex from x), r as (select q, v, c, ex/sum(ex) over(partition by q) risk from m)
select q, v, round(risk,5) as risk, round(c-0.5*risk,5) as score, row_number() over(partition by q order by round(c-0.5*risk,5) desc, c desc, v) as rank from r""")
def rerank(s, d):
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return R.privacy_rerank(e.filter("vec_id % 20 = 0"), e, 8, 0.07, 0.5)


@query("pr08_relevant", "P8", """
with q as (select vec_id q, embedding e from embeddings where vec_id%20=0),
x as (select q.q, e.vec_id v, round(list_dot_product(q.e::double[], e.embedding::double[]),6) c from q join embeddings e on e.vec_id<>q.q qualify row_number() over(partition by q.q order by c desc, v)<=8),
m as (select *, max(c) over(partition by q) top, row_number() over(partition by q order by c desc, v) r from x) select q, v, c as cosine from m where c>=0.5 or (top<0.5 and r=1)""")
def relevant(s, d):
    """Matches from the threshold on; where none reaches it, the best one."""
    e = table(s, d, "embeddings").select("vec_id", "embedding")
    return R.relevant_matches(e.filter("vec_id % 20 = 0"), e, 8, 0.5)


@query("w05_diversified", "W5", """
with t as (select vec_id, label, embedding e, row_number() over(partition by label order by vec_id) rn from embeddings),
a as (select t.label, t.vec_id, t.rn, round(list_dot_product(t.e::double[], h.e::double[]),6) c from t join t h on h.label=t.label and h.rn=1)
select label, vec_id, row_number() over(partition by label order by (rn=1) desc, c, vec_id) as place from a""")
def diversified(s, d):
    e = table(s, d, "embeddings").select("label", "vec_id", "embedding")
    head = e.groupBy("label").agg(F.min("vec_id").alias("first"), F.min_by("embedding", "vec_id").alias("h"))
    a = e.join(F.broadcast(head), "label").withColumn("c", F.round(V.dot(F.col("embedding"), F.col("h")), 6))  # one row per label
    return a.select("label", "vec_id", F.row_number().over(W.partitionBy("label").orderBy(F.when(F.col("vec_id") == F.col("first"), 0).otherwise(1), "c", "vec_id")).cast("long").alias("place"))


@query("j10_lexical_rank", "J10 N5 N6", f"""
with d as (select doc_id, {_TOK} w from documents where text is not null), n as (select count(*) n from d),
tf as (select doc_id, t, count(*) f from (select doc_id, unnest(w) t from d) group by all), df as (select t, count(*) df from tf group by 1),
idf as (select t, ln((n+1)/(df+0.5))+1 idf from df, n), q as (select item_id, t, count(*) f from (select item_id, unnest({_TOK}) t from eval_items) group by all),
qn as (select item_id, sqrt(sum(pow(f*coalesce(idf, ln(((select n from n)+1)/0.5)+1),2))) qn, count(*) qt from q left join idf using(t) group by 1), dn as (select doc_id, sqrt(sum(pow(f*idf,2))) dn from tf join idf using(t) group by 1),
s as (select item_id, doc_id, sum(q.f*tf.f*idf) dot, count(*) common from q join tf using(t) join idf using(t) group by all)
select item_id, doc_id, round(dot/(qn*dn)+0.15*common/qt,5) as score from s join qn using(item_id) join dn using(doc_id) qualify row_number() over(partition by item_id order by round(dot/(qn*dn)+0.15*common/qt,5) desc, doc_id)<=4""")
def lexical_rank(s, d):
    return R.lexical_rank(table(s, d, "eval_items"), table(s, d, "documents"), 4)


@query("a37_retrieval_quality", "A37", """
with q as (select vec_id q, label l, embedding e from embeddings where vec_id%20=0),
x as (select q.q, q.l=e.label hit, row_number() over(partition by q.q order by round(list_dot_product(q.e::double[],e.embedding::double[]),6) desc, e.vec_id) r from q join embeddings e on e.vec_id<>q.q qualify r<=10),
g as (select q, max(case when hit and r<=1 then 1 else 0 end) h1, max(case when hit and r<=3 then 1 else 0 end) h3, coalesce(1.0/min(case when hit then r end),0) rr from x group by 1)
select count(*)::bigint as queries, round(avg(h1),6) as hit_at_1, round(avg(h3),6) as hit_at_3, round(avg(rr),6) as mrr from g""")
def retrieval_quality(s, d):
    e = table(s, d, "embeddings")
    return R.retrieval_quality(e.filter("vec_id % 20 = 0"), e, 10)


@query("w06_word_windows", "W6", r"""
with t as (select source, chunk_id, string_split_regex(trim(regexp_replace(min(text),'[ \t\r\n]+',' ','g')),' ') w from document_chunks where text is not null group by all),
x as (select source, chunk_id, w, unnest(range(0,len(w),48)) i from t)
select source, chunk_id, (i/48)::bigint as piece, least(64,len(w)-i)::bigint as words, md5(array_to_string(w[i+1:i+64],' ')) as h from x""")
def word_windows(s, d):
    t = table(s, d, "document_chunks").filter("text is not null").groupBy("source", "chunk_id").agg(F.min("text").alias("text"))
    return R.word_windows(t, ["source", "chunk_id"], 64, 16)


@query("w03_context_budget", "W3", """
with t as (select distinct source, chunk_id, length(trim(text)) len from document_chunks where text is not null), l as (select source, chunk_id, least(700,len) len from t),
r as (select *, row_number() over(partition by source order by chunk_id) rank, sum(len) over(partition by source order by chunk_id rows unbounded preceding) total from l),
c as (select *, min(case when total>2800 and rank>1 then rank end) over(partition by source) stop from r)
select source, chunk_id, len::bigint as chars, total::bigint as total from c where stop is null or rank<stop""")
def context_budget(s, d):
    t = table(s, d, "document_chunks").filter("text is not null").select("source", "chunk_id", F.least(F.lit(700), F.length(F.trim("text"))).cast("long").alias("chars")).distinct()
    return R.context_budget(t, "source", "chunk_id", 2800)


@query("w09_extractive_summary", "W9 W10 R53", r"""
with t as (select source, chunk_id, min(text) text from document_chunks where text is not null group by all),
x as (select source, chunk_id, string_split(regexp_replace(text,'([.!?])\s+','\1'||chr(1),'g'),chr(1)) ss from t), s as (select source, chunk_id, i, ss[i] sent from (select *, unnest(range(1,len(ss)+1)) i from x)),
k as (select *, list_distinct(list_filter(regexp_extract_all(lower(sent),'[a-z0-9]+'), w -> length(w)>2)) w from s), k2 as (select * from k where len(w)>=5),
df as (select source, chunk_id, w t, count(*) n from (select source, chunk_id, unnest(w) w from k2) group by all),
sc as (select source, chunk_id, i, avg(n)*0.8+0.2/(1.0+(i-1)*0.35) score from (select source, chunk_id, i, unnest(w) t from k2) join df using(source,chunk_id,t) group by source, chunk_id, i)
select source, chunk_id, i::bigint as sentence, round(score,6) as score from sc qualify row_number() over(partition by source, chunk_id order by round(score,6) desc, i)<=2""")
def extractive(s, d):
    t = table(s, d, "document_chunks").filter("text is not null").groupBy("source", "chunk_id").agg(F.min("text").alias("text"))
    return R.extractive_sentences(t, ["source", "chunk_id"], 2)


@query("r61_snippets", "R61 P7", """
with t as (select distinct source, chunk_id, access_level, bloom_level, topic, difficulty, safe_summary, text from document_chunks)
select source, chunk_id, case when access_level='protected' then array_to_string(list_filter([bloom_level,topic,difficulty,safe_summary], x -> x is not null and trim(x)<>''),' | ') else left(text,220) end as index_text from t""")
def snippets(s, d):
    t = table(s, d, "document_chunks").select("source", "chunk_id", "access_level", "bloom_level", "topic", "difficulty", "safe_summary", "text").distinct()
    parts = F.filter(F.array("bloom_level", "topic", "difficulty", "safe_summary"), lambda x: x.isNotNull() & (F.trim(x) != ""))
    return t.select("source", "chunk_id", F.when(F.col("access_level") == "protected", F.array_join(parts, " | ")).otherwise(F.left("text", F.lit(220))).alias("index_text"))


@query("r62_recent_turns", "R62", """
with t as (select distinct turn_id, session_id, turn_no, lower(trim(coalesce(role,'unknown'))) role, content from chat_turns where session_id is not null),
r as (select *, row_number() over(partition by session_id order by turn_no desc, turn_id desc) rn from t)
select session_id, count(*)::bigint as turns, md5(string_agg(role||': '||coalesce(content,''), chr(10) order by turn_no, turn_id)) as transcript from r where rn<=6 group by 1""")
def recent_turns(s, d):
    t = table(s, d, "chat_turns").filter("session_id is not null").select("turn_id", "session_id", "turn_no", F.lower(F.trim(F.coalesce("role", F.lit("unknown")))).alias("role"), "content").distinct()
    r = t.withColumn("rn", F.row_number().over(W.partitionBy("session_id").orderBy(F.desc("turn_no"), F.desc("turn_id")))).filter("rn <= 6")
    line = F.concat("role", F.lit(": "), F.coalesce("content", F.lit("")))
    rows = F.sort_array(F.collect_list(F.struct("turn_no", "turn_id", line.alias("line"))))  # at most six
    return r.groupBy("session_id").agg(F.count("*").alias("turns"), F.md5(F.array_join(F.transform(rows, lambda x: x["line"]), "\n")).alias("transcript"))


# Wordings of a query that are a risk, and names of protected artifacts.
_RISK = [
    r"\bverbatim\b",
    r"\bexact (text|question|paper)\b",
    r"\breconstruct\b",
    r"\brecover\b",
    r"\breveal\b",
    r"\bshow (me )?(the )?(question paper|exam paper|uploaded exam)\b",
    r"\bwhat (are|were) the questions\b",
    r"\bfull (question paper|exam paper|paper)\b",
    r"\blist (all|the) questions\b",
    r"\bcopy\b",
    r"\bquote\b",
    r"\bmoderation paper\b",
    r"\bwithout (copying|quoting)\b.*\b(exam|paper|question)",
    r"\bin (your own words|plain english)\b.*\b(exam|paper|question)",
    r"\bparaphrase\b.*\b(exam|paper|question|protected|uploaded)",
    r"\btopics?\b.*\b(uploaded|protected|exam|question paper)",
    r"\bwhat does the (uploaded|protected) (exam|paper)\b.*\bcover\b",
    r"\bsummarize\b.*\b(uploaded|protected|previously uploaded)\b.*\b(document|documents|exam|paper|questions?)\b",
    r"\b(previously uploaded|uploaded)\b.*\b(document|documents|exam|paper|questions?)\b",
    r"\bgive\b.*\b(uploaded|protected|previously uploaded)\b.*\b(document|documents|exam|paper|questions?)\b",
    r"\bfirst\b.*\bthen\b.*\b(protected|exam|paper)",
    r"\bprevious answer\b.*\b(protected|exam|question)",
]
_ARTIFACTS = [r"\buploaded\b", r"\bprotected\b", r"\bexam\b", r"\bquestion paper\b", r"\buploaded document\b", r"\buploaded documents\b", r"\bpreviously uploaded\b", r"\bpaper\b", r"\bmoderation\b"]
_RISK_SQL = "+".join(f"(case when regexp_matches(lower(text),'{p}') then 1 else 0 end)" for p in _RISK)
_ARTIFACT_SQL = " or ".join(f"regexp_matches(lower(text),'{p}')" for p in _ARTIFACTS)
_ALIASES_IN = "list_filter([" + ",".join(f"case when list_has_any(b,{_sql_list(v)}) then '{k}' end" for k, v in X.CONCEPT_ALIASES.items()) + "], x -> x is not null)"


def _leak_sql(rows):
    """x: what rows (turn_id, text, ...) share with the evaluation items."""
    concepts = f"list_distinct(list_filter({_TOK}, x -> length(x)>=3 and not list_contains({_sql_list(X.CONCEPT_STOPWORDS)},x)))"
    return f"""t as {rows},
g8 as (select distinct turn_id from {_grams('t', 'turn_id', 8)} join (select distinct gram from {_grams('eval_items', 'item_id', 8)}) using(gram)),
g5 as (select turn_id, avg((p.gram is not null)::int) c from {_grams('t', 'turn_id', 5)} a left join (select distinct gram from {_grams('eval_items', 'item_id', 5)}) p using(gram) group by 1),
pt as (select t, count(*) m from (select unnest({_TOK}) t from eval_items) group by 1), ct as (select turn_id, w, count(*) n from (select turn_id, unnest({_TOK}) w from t) group by all),
o as (select turn_id, sum(least(n,coalesce(m,0)))/sum(n)::double o, sum(n) n from ct left join pt on pt.t=ct.w group by 1),
pc as (select distinct unnest(list_concat(b,{_ALIASES_IN})) w from (select {concepts} b from eval_items)), cc as (select turn_id, unnest(list_distinct(list_concat(b,{_ALIASES_IN}))) w from (select turn_id, {concepts} b from t)),
k as (select turn_id, count(*) k, sum((pc.w is not null)::int)/count(*)::double r from cc left join pc using(w) group by 1),
x as (select t.*, g8.turn_id is not null span, coalesce(c,0)::double c, coalesce(o,0)::double o, coalesce(n,0) n, coalesce(k,0) k, coalesce(r,0)::double r from t left join g8 using(turn_id) left join g5 using(turn_id) left join o using(turn_id) left join k using(turn_id))"""


@query("pr01_screening", "P1 P2 P4 T5 T17 T18", f"""
with {_leak_sql("(select distinct turn_id, coalesce(content,'') as text from chat_turns)")}, y as (select *, {_RISK_SQL} hits, ({_ARTIFACT_SQL}) art from x),
z as (select *, case when trim(text)='' then 'empty_query' when hits>0 then 'reconstruction_intent_detected' when art and o>=0.12 then 'artifact_reference_with_overlap' when span then 'protected_span_in_query' when art and c>=0.35 then 'protected_ngram_query' when art and r>=0.62 then 'protected_semantic_query' when o>=0.85 and n>=8 then 'query_overlap_high' else 'ok' end reason from y)
select turn_id, reason, round(case reason when 'empty_query' then 1.0 when 'reconstruction_intent_detected' then least(1.0,0.2*hits) when 'protected_span_in_query' then 1.0 when 'protected_ngram_query' then c when 'protected_semantic_query' then r else o end,6) as risk, art as names_artifact from z""")
def screening(s, d):
    from spindrift.operators.screening import screen

    t = table(s, d, "chat_turns").select("turn_id", F.coalesce("content", F.lit("")).alias("text")).distinct()
    return screen(t, "turn_id", table(s, d, "eval_items"), "item_id", _RISK, _ARTIFACTS)


_STAFF = "(select distinct turn_id, coalesce(content,'') as text, lower(trim(coalesce(role,''))) in ('teacher','moderator','admin','assistant') staff from chat_turns)"


@query("pr03_output_screen", "P3 T5 T17 T18", f"""
with {_leak_sql(_STAFF)}, z as (select *, case when span then 's' when c>=0.35 and n>=5 then 'c' when not staff and r>=0.62 and k>=4 then 'r' when o>=0.55 and n>=8 then 'o' else 'ok' end w from x)
select turn_id, case w when 's' then (case when staff then 'teacher_output_copied_protected_span' else 'protected_span_copied' end) when 'c' then (case when staff then 'teacher_output_copied_protected_ngram' else 'protected_ngram_copied' end) when 'r' then 'protected_semantic_leakage' when 'o' then (case when staff then 'teacher_output_high_protected_overlap' else 'protected_overlap_high' end) else 'ok' end as reason,
round(case w when 's' then 1.0 when 'c' then c when 'r' then r when 'o' then o else greatest(o,c) end,6) as risk from z""")
def output_screen(s, d):
    """Turns as outputs; those of the assistant stand for outputs to staff, as the test table has no other readers."""
    from spindrift.operators.screening import screen_outputs

    staff = F.lower(F.trim(F.coalesce("role", F.lit("")))).isin("teacher", "moderator", "admin", "assistant")
    t = table(s, d, "chat_turns").select("turn_id", F.coalesce("content", F.lit("")).alias("text"), staff.alias("staff")).distinct()
    return screen_outputs(t, "turn_id", table(s, d, "eval_items"), "item_id")


@query("pr05_visible", "P5", "select content_type, count(*)::bigint as documents, sum(case when access_level='public' then 1 else 0 end)::bigint as open_documents from documents group by 1")
def visible(s, d):
    return table(s, d, "documents").groupBy("content_type").agg(F.count("*").alias("documents"), F.count_if(F.col("access_level") == "public").alias("open_documents"))


@query("n07_divergence", "N7 N8", """
with t as (select vec_id, list_transform(embedding[1:32], x -> exp(x::double)) e, list_transform(embedding[33:64], x -> exp(x::double)) f from embeddings),
p as (select vec_id, list_transform(e, x -> x/list_sum(e)) p, list_transform(f, x -> x/list_sum(f)) q from t), m as (select *, list_transform(list_zip(p,q), z -> (z[1]+z[2])/2) m from p)
select vec_id, round(list_sum(list_transform(p, x -> -x*ln(x)))/ln(32),6) as entropy, round((list_sum(list_transform(list_zip(p,m), z -> z[1]*ln(z[1]/z[2])))+list_sum(list_transform(list_zip(q,m), z -> z[1]*ln(z[1]/z[2]))))/2/ln(2),6) as divergence from m""")
def divergence(s, d):
    e = table(s, d, "embeddings").select("vec_id", V.softmax(F.transform(F.slice("embedding", 1, 32), lambda x: x.cast("double"))).alias("p"), V.softmax(F.transform(F.slice("embedding", 33, 32), lambda x: x.cast("double"))).alias("q"))
    return e.select("vec_id", F.round(V.entropy(F.col("p")), 6).alias("entropy"), F.round(V.jensen_shannon(F.col("p"), F.col("q")), 6).alias("divergence"))


@query("n14_clipped", "N14 N15", "select vec_id, round(sqrt(list_sum(list_transform(embedding, x -> pow(x::double*least(1.0,0.5/sqrt(list_dot_product(embedding::double[],embedding::double[]))),2)))),5) as norm from embeddings")
def clipped(s, d):
    c = V.clip(F.col("embedding"), 0.5)
    return table(s, d, "embeddings").select("vec_id", F.round(V.norm(c), 5).alias("norm"))


@query("n13_logistic", "N13", "select vec_id, round(1/(1+exp(-greatest(-30,least(30,list_sum(list_transform(range(1,65), i -> embedding[i]::double*sin(i))))))),6) as score from embeddings")
def logistic(s, d):
    z = F.aggregate(F.transform("embedding", lambda x, i: x.cast("double") * F.sin(i + 1)), F.lit(0.0), lambda a, x: a + x)
    return table(s, d, "embeddings").select("vec_id", F.round(1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z)))), 6).alias("score"))


@query("n24_json_path", "N24 N26", "select event_type, sum(cast(json_extract(props,'$.k') as bigint))::bigint as k, count(*)::bigint as n from events group by 1")
def json_path(s, d):
    return table(s, d, "events").groupBy("event_type").agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k"), F.count("*").alias("n"))
