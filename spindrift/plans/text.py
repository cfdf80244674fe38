"""Queries on text functions (T rows, G3, R51, P4, P15, P16, P23, P24)."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.plans.registry import query
from spindrift.runtime import table

_TOK = "regexp_extract_all(lower(text),'[a-z0-9]+')"


def _docs(s, d):
    return table(s, d, "documents").filter("text is not null")


@query("t01_tidy_lines", "T1", r"""
select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text,'[ \t\r\f]+',' ','g'),' ?\n ?',chr(10),'g'),'\n{3,}',chr(10)||chr(10),'g'))) as h
from documents where text is not null""")
def tidy_lines(s, d):
    return _docs(s, d).select("doc_id", F.md5(X.tidy_lines(F.col("text"))).alias("h"))


@query("t02_collapsed", "T2 R51", r"""
select doc_id, md5(trim(regexp_replace(lower(text),'[ \t\r\n]+',' ','g'))) as collapsed, md5(trim(regexp_replace(lower(text),'[^a-z0-9]+',' ','g'))) as normalized
from documents where text is not null""")
def collapsed(s, d):
    return _docs(s, d).select("doc_id", F.md5(X.collapse(F.col("text"))).alias("collapsed"), F.md5(X.normalize(F.col("text"))).alias("normalized"))


@query("t03_tokens", "T3 T4", f"select doc_id, len({_TOK})::bigint as n_tokens, len(list_distinct({_TOK}))::bigint as n_distinct from documents where text is not null")
def token_counts(s, d):
    t = X.tokens(F.col("text"))
    return _docs(s, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


def _sql_list(w):
    return "[" + ",".join(f"'{x}'" for x in w) + "]"


_ALIAS_SQL = "+".join(f"(case when not list_contains(b,'{k}') and list_has_any(b,{_sql_list(v)}) then 1 else 0 end)" for k, v in X.CONCEPT_ALIASES.items())


@query("t05_concepts", "T5", f"""
with t as (select doc_id, list_distinct(list_filter({_TOK}, x -> length(x)>=3 and not list_contains({_sql_list(X.CONCEPT_STOPWORDS)},x))) b from documents where text is not null)
select doc_id, (len(b)+{_ALIAS_SQL})::bigint as concepts from t""")
def concepts(s, d):
    return _docs(s, d).select("doc_id", F.size(X.concept_tokens(F.col("text"))).cast("long").alias("concepts"))


_NORM_SQL = "trim(regexp_replace(lower({c}),'[^a-z0-9]+',' ','g'))"


def _content_sql(c, stop):
    return f"list_distinct(list_filter(string_split({_NORM_SQL.format(c=c)},' '), x -> length(x)>=3 and not list_contains({_sql_list(stop)},x)))"


@query("t06_content_tokens", "T6 T7", f"""
select doc_id, len({_content_sql('text', X.VALIDATION_STOPWORDS)})::bigint as content, len({_content_sql('text', X.VALIDATION_STOPWORDS + X.LEVEL_VERBS)})::bigint as without_verbs
from documents where text is not null""")
def content(s, d):
    t = F.col("text")
    return _docs(s, d).select("doc_id", F.size(X.content_tokens(t, X.VALIDATION_STOPWORDS)).cast("long").alias("content"), F.size(X.content_tokens(t, X.VALIDATION_STOPWORDS + X.LEVEL_VERBS)).cast("long").alias("without_verbs"))


@query("t08_topic_terms", "T8", r"select doc_id, len(list_distinct(regexp_extract_all(lower(text),'[a-z][a-z0-9_-]{2,}')))::bigint as terms from documents where text is not null")
def topic_terms(s, d):
    return _docs(s, d).select("doc_id", F.size(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z][a-z0-9_-]{2,}"), F.lit(0)))).cast("long").alias("terms"))


@query("t09_ngrams", "T9 T10", f"""
with t as (select doc_id, {_TOK} w from documents where text is not null),
g as (select doc_id, w, unnest(case when len(w)>=5 then range(1,len(w)-3) else [] end) i from t),
n as (select doc_id, count(*) c, count(distinct array_to_string(w[i:i+4],' ')) u from g group by 1)
select doc_id, coalesce(c,0)::bigint as grams, coalesce(u,0)::bigint as distinct_grams from t left join n using(doc_id)""")
def ngram_counts(s, d):
    g = X.ngrams(X.tokens(F.col("text")), 5)
    return _docs(s, d).select("doc_id", F.size(g).cast("long").alias("grams"), F.size(F.array_distinct(g)).cast("long").alias("distinct_grams"))


@query("t12_rewrite_similarity", "T11 T12 T13 T16", f"""
with p as (select distinct id, source_question q, prediction p from predictions where source_question is not null and prediction is not null),
t as (select id, {_content_sql('q', X.VALIDATION_STOPWORDS)} a, {_content_sql('p', X.VALIDATION_STOPWORDS)} b, string_split({_NORM_SQL.format(c='q')},' ') wa, string_split({_NORM_SQL.format(c='p')},' ') wb from p)
select id, round(case when len(a)=0 and len(b)=0 then 1.0 else len(list_intersect(a,b))/(len(a)+len(b)-len(list_intersect(a,b)))::double end,6) as jaccard,
round(case when len(a)=0 then 0.0 else len(list_intersect(a,b))/len(a)::double end,6) as retained, abs(len(wa)-len(wb))::bigint as word_gap from t""")
def rewrite_similarity(s, d):
    p = table(s, d, "predictions").select("id", F.col("source_question").alias("q"), F.col("prediction").alias("p")).filter("q is not null and p is not null").distinct()
    a, b = X.content_tokens(F.col("q"), X.VALIDATION_STOPWORDS), X.content_tokens(F.col("p"), X.VALIDATION_STOPWORDS)
    words = lambda c: F.size(F.split(X.normalize(F.col(c)), " "))
    p = p.select("id", a.alias("a"), b.alias("b"), F.abs(words("q") - words("p")).cast("long").alias("word_gap"))
    return p.select("id", F.round(X.jaccard(F.col("a"), F.col("b")), 6).alias("jaccard"), F.round(X.containment(F.col("a"), F.col("b")), 6).alias("retained"), "word_gap")


@query("t15_keyword_overlap", "T15", """
with k as (select ['queue','resin','treaty','kidney','sonata','statue','harbour'] k)
select doc_id, round(len(list_filter(k, x -> contains(lower(text),x)))/7.0::double,6) as overlap from documents, k where text is not null""")
def keyword_overlap(s, d):
    k = X.array_of(["queue", "resin", "treaty", "kidney", "sonata", "statue", "harbour"])
    return _docs(s, d).select("doc_id", F.round(F.size(F.filter(k, lambda w: F.lower("text").contains(w))) / 7.0, 6).alias("overlap"))


@query("t17_multiset_overlap", "T17 G3", f"""
with a as (select item_id, t, count(*) n from (select item_id, unnest({_TOK}) t from eval_items) group by all),
q as (select item_id, sum(n) total from a group by 1),
b as (select doc_id, t, count(*) n from (select doc_id, unnest({_TOK}) t from documents) group by all),
o as (select item_id, doc_id, sum(least(a.n,b.n)) shared from a join b using(t) group by all)
select item_id, doc_id, shared::bigint as shared, round(shared/total::double,6) as ratio from o join q using(item_id) qualify row_number() over(partition by item_id order by shared desc, doc_id)<=3""")
def multiset_overlap(s, d):
    from spindrift.operators.similarity import multiset_overlap as f

    return f(table(s, d, "eval_items"), table(s, d, "documents"), 3)


@query("t20_topic", "T20", r"""
select distinct id, trim(regexp_replace(regexp_replace(source_question,'^(what is|what are|explain|describe|compare|list|name|state|why does|how would you adapt|show how|design|compose|assess the claim that|judge whether|do you agree that)\s+','','i'),'[?.!]+\s*$','')) as topic
from predictions where source_question is not null and task='qa'""")
def topic(s, d):
    q = F.regexp_replace("source_question", r"(?i)^(what is|what are|explain|describe|compare|list|name|state|why does|how would you adapt|show how|design|compose|assess the claim that|judge whether|do you agree that)\s+", "")
    p = table(s, d, "predictions").filter("source_question is not null and task = 'qa'")
    return p.select("id", F.trim(F.regexp_replace(q, r"[?.!]+\s*\z", "")).alias("topic")).distinct()


@query("t23_variant_index", "T23 W17 N21", """
select doc_id, sha256(text)[1:10] as short_hash, (('0x'||sha256(text)[1:8])::bigint % 5)::bigint as variant from documents where text is not null""")
def variant(s, d):
    return _docs(s, d).select("doc_id", F.substring(F.sha2("text", 256), 1, 10).alias("short_hash"), X.bucket(F.col("text"), 5).alias("variant"))


_Q = r"^(what|why|how|which|when|where|who|whom|whose|define|explain|describe|list|name|identify|state|recall|recognize|summarize|interpret|illustrate|distinguish|differentiate|break down|categorize|classify|infer|predict|outline|rank|prioritize|organize|investigate|inspect|derive|select|support|defend|recommend|compare|contrast|evaluate|assess|design|propose|create|develop|formulate|construct|analyze|analyse|examine|discuss|calculate|compute|determine|apply|use|solve|justify|critique|given|using|for the following|in the following|consider) "
FORMS_SQL = rf"""
with p as (select distinct id, coalesce(prediction,'') p from predictions), n as (select id, p, trim(regexp_replace(lower(p),'[^a-z0-9]+',' ','g')) n from p),
f as (select id, p, n, contains(p,'?') or regexp_matches(n||' ','{_Q}') q, regexp_matches(n,'\bas an ai\b|\bi (?:cannot|can t|won t)\b|\brewrit(?:e|ten|ing)\b|\bbloom(?: s)?\s+level\b|\btarget\s+level\b|\boriginal\s+question\b|\bhere is\b|\bhere s the\b') m from n),
a as (select *, regexp_matches(n,'\bthe answer is\b|\binsufficient information\b') or m or (not contains(p,'?') and not q) or regexp_matches(n,'^(it|this|that|there|these|those) (is|are|was|were|means|refers)\b') a from f)
select id, q as question, m as meta, a as answer, (not contains(p,'?') and q and not a) as imperative from a"""


@query("t24_forms", "T24 T25 T26 P15", FORMS_SQL)
def forms(s, d):
    p = table(s, d, "predictions").select("id", F.coalesce("prediction", F.lit("")).alias("p")).distinct()
    c = F.col("p")
    p = p.select("id", "p", X.is_question(c).alias("question"), X.has_meta(c).alias("meta"), X.is_answer(c).alias("answer"))
    return p.select("id", "question", "meta", "answer", (~F.col("p").contains("?") & F.col("question") & ~F.col("answer")).alias("imperative"))


@query("t30_cleaned", "T30 T31 T28", r"""
select distinct diag_id, trim(regexp_replace(regexp_replace(regexp_replace(raw_output,'<\|[a-z_]+\|>','','g'),'^\s*(Answer|Rewritten|Question|Here is the rewritten question|Certainly, see below\.?|Sure!)\s*:?\s*','','i'),'\s+',' ','g')) as cleaned
from target_rewrite_diagnostic where raw_output is not null""")
def cleaned(s, d):
    t = table(s, d, "target_rewrite_diagnostic").filter("raw_output is not null")
    c = F.regexp_replace("raw_output", r"<\|[a-z_]+\|>", "")
    c = F.regexp_replace(c, r"(?i)^\s*(Answer|Rewritten|Question|Here is the rewritten question|Certainly, see below\.?|Sure!)\s*:?\s*", "")
    return t.select("diag_id", F.trim(F.regexp_replace(c, r"\s+", " ")).alias("cleaned")).distinct()


VERBS = "identify list state name define recall recognize specify explain describe interpret summarize classify illustrate apply use calculate compute solve demonstrate predict examine compare trace differentiate contrast analyze distinguish assess evaluate critique justify judge rank recommend defend design develop formulate construct propose compose plan create outline invent".split()


@query("t32_first_verb", "T32 A32", f"""
with p as (select distinct id, prediction from predictions where prediction is not null),
w as (select id, list_filter((list_transform(regexp_extract_all(prediction,'[A-Za-z]+'), x -> lower(x)))[1:10], x -> list_contains({_sql_list(VERBS)},x)) v from p),
f as (select id, coalesce(v[1],'(none)') verb from w)
select verb, count(*)::bigint as n, round(count(*)/sum(count(*)) over ()::double,6) as share from f group by verb""")
def first_verb(s, d):
    from pyspark.sql import Window as W

    p = table(s, d, "predictions").select("id", "prediction").filter("prediction is not null").distinct()
    words = F.transform(F.slice(F.regexp_extract_all("prediction", F.lit("[A-Za-z]+"), F.lit(0)), 1, 10), F.lower)
    verb = F.coalesce(F.get(F.filter(words, lambda w: F.array_contains(X.array_of(VERBS), w)), F.lit(0)), F.lit("(none)"))
    g = p.select(verb.alias("verb")).groupBy("verb").agg(F.count("*").alias("n"))
    return g.select("verb", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy()), 6).alias("share"))  # one row per verb


# Separators behind which a text may be cut, in this order.
_SEPARATORS = [".\n", ".\n\n", ". ", "\n", " "]
_SEP_SQL = "".join(f" when {200 - len(x)}-(strpos(reverse(cut),{y})-1)>66 and strpos(reverse(cut),{y})>0 then 200-(strpos(reverse(cut),{y})-1)" for x, y in ((x, "||".join("chr(10)" if c == "\n" else f"'{c}'" for c in reversed(x))) for x in _SEPARATORS))


@query("t36_truncated_at_separator", "T36", rf"""
with t as (select source, chunk_id, regexp_replace(regexp_replace(min(text),'^[ \t\r\n]+',''),'[ \t\r\n]+$','') t from document_chunks where text is not null group by all), c as (select *, t[1:200] cut from t)
select source, chunk_id, length(case when length(t)<=200 then t else regexp_replace(cut[1:(case{_SEP_SQL} else 200 end)],'[ \t\r\n]+$','') end)::bigint as kept from c""")
def truncated_at_separator(s, d):
    """Length kept of each text: up to the last place of the first separator that has one past a third of the limit."""
    t = table(s, d, "document_chunks").filter("text is not null").groupBy("source", "chunk_id").agg(F.min("text").alias("text"))
    bare = F.regexp_replace(F.regexp_replace("text", r"\A[ \t\r\n]+", ""), r"[ \t\r\n]+\z", "")
    t = t.select("source", "chunk_id", bare.alias("t")).withColumn("back", F.reverse(F.left("t", F.lit(200))))
    end = F.lit(200)
    for x in reversed(_SEPARATORS):
        at = F.locate(x[::-1], F.col("back"))
        end = F.when((at > 0) & (200 - len(x) - (at - 1) > 66), 201 - at).otherwise(end)
    kept = F.regexp_replace(F.left("t", end), r"[ \t\r\n]+\z", "")
    return t.select("source", "chunk_id", F.length(F.when(F.length("t") <= 200, F.col("t")).otherwise(kept)).cast("long").alias("kept"))


@query("t37_answer_match", "T37 A13 A14", r"""
with p as (select distinct id, trim(regexp_replace(lower(regexp_replace(prediction,'[^A-Za-z0-9 \n\t]','','g')),'[ \n\t]+',' ','g')) a, trim(regexp_replace(lower(regexp_replace(reference,'[^A-Za-z0-9 \n\t]','','g')),'[ \n\t]+',' ','g')) b from predictions where task='qa' and prediction is not null and reference is not null),
ta as (select id, w, count(*) n from (select id, unnest(string_split(a,' ')) w from p) where w<>'' group by all), tb as (select id, w, count(*) n from (select id, unnest(string_split(b,' ')) w from p) where w<>'' group by all),
c as (select id, sum(least(ta.n,tb.n)) m from ta join tb using(id,w) group by 1), na as (select id,sum(n) n from ta group by 1), nb as (select id,sum(n) n from tb group by 1)
select p.id, (a=b) as exact, round(case when coalesce(na.n,0)=0 and coalesce(nb.n,0)=0 then 1.0 when coalesce(m,0)=0 then 0.0 else 2.0*m/(na.n+nb.n) end,6) as f1 from p left join c using(id) left join na using(id) left join nb using(id)""")
def answer_match(s, d):
    from spindrift.operators.metrics import token_f1

    p = table(s, d, "predictions").filter("task = 'qa' and prediction is not null and reference is not null")
    p = p.select("id", X.answer_form(F.col("prediction")).alias("a"), X.answer_form(F.col("reference")).alias("b")).distinct()
    return p.select("id", (F.col("a") == F.col("b")).alias("exact"), F.round(token_f1(F.col("a"), F.col("b")), 6).alias("f1"))


@query("t38_prompt", "T38 T39", """
select distinct id, md5('<|user|>'||chr(10)||'Rewrite at level '||target_bloom_level||': '||source_question||chr(10)||'<|assistant|>'||chr(10)) as prompt, contains(lower(source_question),'source level') as leaks
from predictions where task='bloom_rewrite' and target_bloom_level is not null and source_question is not null""")
def prompt(s, d):
    p = table(s, d, "predictions").filter("task = 'bloom_rewrite' and target_bloom_level is not null and source_question is not null")
    text = F.concat(F.lit("<|user|>\nRewrite at level "), "target_bloom_level", F.lit(": "), "source_question", F.lit("\n<|assistant|>\n"))
    return p.select("id", F.md5(text).alias("prompt"), F.lower("source_question").contains("source level").alias("leaks")).distinct()


@query("t41_genre", "T41", r"""
with t as (select doc_id, text, len(regexp_extract_all(text,'(?m)^(Week|Lab|Summary|Tutorial sheet|Past paper|Unit) \d+')) h, len(regexp_extract_all(lower(text),'question \d+|answer key|exam answer')) e, len(regexp_extract_all(lower(text),'definition|theorem|proof')) f from documents where text is not null)
select doc_id, h::bigint as headings, e::bigint as exam_marks, case when e>=2 then 'exam' when f>=2 then 'notes' when h>=1 then 'sheet' else 'other' end as genre from t""")
def genre(s, d):
    n = lambda c, p: F.regexp_count(c, F.lit(p)).cast("long")
    t = _docs(s, d).select("doc_id", n(F.col("text"), r"(?m)^(Week|Lab|Summary|Tutorial sheet|Past paper|Unit) \d+").alias("headings"), n(F.lower("text"), r"question \d+|answer key|exam answer").alias("exam_marks"), n(F.lower("text"), "definition|theorem|proof").alias("f"))
    return t.select("doc_id", "headings", "exam_marks", F.when(F.col("exam_marks") >= 2, "exam").when(F.col("f") >= 2, "notes").when(F.col("headings") >= 1, "sheet").otherwise("other").alias("genre"))
