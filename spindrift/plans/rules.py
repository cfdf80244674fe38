"""Rule tables for rewrites and outputs, windows around answers, verb pools and guard rates (P, T, R and W rows)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.functions import vectors as V
from spindrift.operators.similarity import term_counts
from spindrift.plans.registry import query
from spindrift.plans.text import _TOK, _sql_list
from spindrift.runtime import table

LEVELS = ["Remember", "Understand", "Apply", "Analyze", "Evaluate", "Create"]
# What a task of each level must say, what it must not say, and its cue words.
REQUIRED = {
    "Remember": [
        r"\b(identify|list|name|define|recognize|recall|state|label)\b.*\s+(the|a|an|what|which|who)",
        r"\b(identify|list|name|define|recognize|recall|state|label)\b.*\s+(components|parts|elements|steps|stages|types|kinds|examples)",
    ],
    "Understand": [
        r"\b(explain|describe|summarize|interpret|classify|discuss)\b.*\s+(the|a|an|how|why|what)",
        r"\b(explain|describe|summarize|interpret|classify|discuss)\b.*\s+(principles|concepts|ideas|meaning|relationship|function)",
    ],
    "Apply": [
        r"\b(apply|use|demonstrate|implement|solve|execute)\b.*\s+(to|for|in|with)",
        r"\b(apply|use|demonstrate|implement|solve|execute)\b.*\s+(problem|situation|case|scenario|example)",
    ],
    "Analyze": [
        r"\b(analyze|compare|differentiate|examine|investigate|categorize)\b.*\s+(the|a|an|and|between|with)",
        r"\b(analyze|compare|differentiate|examine|investigate|categorize)\b.*\s+(relationship|differences|similarities|patterns|structure|components)",
    ],
    "Evaluate": [
        r"\b(evaluate|assess|justify|critique|defend|judge)\b.*\s+(the|a|an|using|based on|according to)",
        r"\b(evaluate|assess|justify|critique|defend|judge)\b.*\s+(effectiveness|quality|validity|merits|strengths|weaknesses)",
    ],
    "Create": [
        r"\b(design|develop|construct|formulate|propose|create)\b.*\s+(a|an|the)",
        r"\b(design|develop|construct|formulate|propose|create)\b.*\s+(system|model|plan|solution|product|application|structure)",
    ],
}
FORBIDDEN = {
    "Remember": [r"\b(define and design|define and create|define and develop|define and construct)\b", r"\b(design and define|create and define|develop and define)\b"],
    "Understand": [
        r"\b(explain)\b.*\s+(how to design|how to develop|how to create|how to construct)",
        r"\b(describe)\b.*\s+(how to design|how to develop|how to create|how to construct)",
        r"\b(explain and design|explain and develop|explain and create|explain and construct)\b",
        r"\b(design and explain|develop and explain|create and explain|construct and explain)\b",
    ],
    "Apply": [r"\b(apply and design|apply and create|apply and develop)\b", r"\b(design and apply|create and apply|develop and apply)\b"],
    "Analyze": [
        r"\b(analyze and design|analyze and develop|analyze and create|analyze and construct)\b",
        r"\b(compare and design|compare and develop|compare and create)\b",
        r"\b(design and analyze|develop and analyze|create and analyze)\b",
    ],
    "Evaluate": [r"\b(explain and evaluate|describe and evaluate)\b", r"\b(evaluate and explain|evaluate and describe)\b"],
}
CUES = {
    "Remember": ["list", "name", "define", "state", "identify", "recall", "what is", "which of"],
    "Understand": ["explain", "describe", "summarize", "interpret", "classify", "discuss", "why"],
    "Apply": ["apply", "calculate", "solve", "use", "demonstrate", "scenario", "case", "given"],
    "Analyze": ["analyze", "analyse", "compare", "contrast", "differentiate", "examine", "relationship"],
    "Evaluate": ["evaluate", "assess", "justify", "critique", "judge", "strength", "weakness", "criteria"],
    "Create": ["design", "develop", "create", "propose", "formulate", "construct", "plan", "invent"],
}
_REWRITES = "(select distinct id, lower(prediction) p, upper(left(trim(target_bloom_level),1))||lower(substring(trim(target_bloom_level),2)) lvl from predictions where task='bloom_rewrite' and prediction is not null and target_bloom_level is not null)"


def _rewrites(s, d):
    p = table(s, d, "predictions").filter("task = 'bloom_rewrite' and prediction is not null and target_bloom_level is not null")
    t = F.trim("target_bloom_level")
    return p.select("id", F.lower("prediction").alias("p"), F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substring(t, 2, 99))).alias("lvl")).distinct()


def _by_level(rules, text):
    """Whether a text matches one of its level's patterns."""
    out = F.lit(False)
    for k, ps in rules.items():
        any_of = text.rlike(ps[0])
        for p in ps[1:]:
            any_of = any_of | text.rlike(p)
        out = F.when(F.col("lvl") == k, any_of).otherwise(out)
    return out


def _case(rules):
    return "case lvl " + " ".join(f"when '{k}' then " + " or ".join(f"regexp_matches(p,'{p}')" for p in ps) for k, ps in rules.items()) + " else false end"


@query("pr18_task_structure", "P18", f"select id, case when {_case(FORBIDDEN)} then 'forbidden' when not {_case(REQUIRED)} then 'no_pattern' else 'ok' end as verdict from {_REWRITES}")
def task_structure(s, d):
    verdict = F.when(_by_level(FORBIDDEN, F.col("p")), "forbidden").when(~_by_level(REQUIRED, F.col("p")), "no_pattern").otherwise("ok")
    return _rewrites(s, d).select("id", verdict.alias("verdict"))


@query("t27_cues", "T27 R48 P15", "select id, " + ", ".join(f"len(list_filter({_sql_list(v)}, x -> contains(p,x)))::bigint as {k.lower()}" for k, v in CUES.items()) + f" from {_REWRITES}")
def cues(s, d):
    return _rewrites(s, d).select("id", *[F.size(F.filter(X.array_of(v), lambda w: F.col("p").contains(w))).cast("long").alias(k.lower()) for k, v in CUES.items()])


# Pools of verbs by cue.
_APPLY = [(r"\b(calculat|comput|numeric|equation|formula|percentage|probability|sum|average|distance|speed|cost|rate)\w*\b", ["Calculate", "Compute", "Determine"]), (r"\b(error|debug|fault|failure|bug|diagnos)\w*\b", ["Diagnose", "Test", "Investigate"]), (r"\b(given|input|output|scenario|case|example|algorithm|procedure|method)\b", ["Use", "Apply", "Demonstrate", "Execute"])]
_ELSE = ["Demonstrate", "Apply", "Use", "Determine"]


@query("t33_verb_pool", "T33", f"""
with q as (select distinct source_question s, lower(source_question) q from predictions where source_question is not null), p as (select s, q, {' '.join(['case'] + [f"when regexp_matches(q,'{p}') then {_sql_list(v)}" for p, v in _APPLY])} else {_sql_list(_ELSE)} end v from q)
select md5(s) as question, v[('0x'||sha256('Apply|'||trim(regexp_replace(q,'[ ]+',' ','g')))[1:8])::bigint%len(v)+1] as verb from p""")
def verb_pool(s, d):
    """The pool by cue, the verb by hash; a rotation per process can't be repeated, so its turn is 0."""
    q = table(s, d, "predictions").filter("source_question is not null").select("source_question").distinct().withColumn("q", F.lower("source_question"))
    pool = X.array_of(_ELSE)
    for p, v in reversed(_APPLY):
        pool = F.when(F.col("q").rlike(p), X.array_of(v)).otherwise(pool)
    n = F.conv(F.substring(F.sha2(F.concat(F.lit("Apply|"), F.trim(F.regexp_replace("q", "[ ]+", " "))), 256), 1, 8), 16, 10).cast("long")
    return q.withColumn("v", pool).select(F.md5("source_question").alias("question"), F.element_at("v", (n % F.size("v") + 1).cast("int")).alias("verb"))


@query("w13_runner_up", "W13 W14 N25", f"""
with t as (select vec_id, list_transform(range(1,7), k -> exp(list_sum(list_transform(list_filter(range(1,len(embedding)+1), i -> (i-1)%6=k-1), i -> embedding[i]::double)))) e from embeddings), p as (select vec_id, list_transform(e, x -> x/list_sum(e)) p from t), r as (select vec_id, i, p[i] v, row_number() over(partition by vec_id order by round(p[i],9) desc, i) k from (select *, unnest(range(1,7)) i from p))
select a.vec_id, {_sql_list(LEVELS)}[a.i] as level, case when b.v>=0.12 then {_sql_list(LEVELS)}[b.i] end as runner_up, {_sql_list(LEVELS)}[least(a.i+1,6)] as next_level from r a join r b on a.vec_id=b.vec_id and a.k=1 and b.k=2""")
def runner_up(s, d):
    e = table(s, d, "embeddings").select("vec_id", V.softmax(F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.aggregate(F.filter("embedding", lambda x, i: i % 6 == k), F.lit(0.0), lambda a, x: a + x.cast("double")))).alias("p"))
    order = F.array_sort(F.transform("p", lambda x, i: F.struct((-F.round(x, 9)).alias("m"), i.alias("i"), x.alias("v"))))
    e = e.select("vec_id", F.get(order, F.lit(0)).alias("a"), F.get(order, F.lit(1)).alias("b"))
    name = lambda i: F.get(X.array_of(LEVELS), i)
    return e.select("vec_id", name(F.col("a.i")).alias("level"), F.when(F.col("b.v") >= 0.12, name(F.col("b.i"))).alias("runner_up"), name(F.least(F.col("a.i") + 1, F.lit(5))).alias("next_level"))


@query("r37_loss_mask", "R37 T38", """
select item_id, list_sum(list_transform(range(len(w)), i -> case when i<6 then -100 else length(w[i+1]) end))::bigint as total from (select item_id, regexp_extract_all(lower(text),'[a-z0-9]+') w from eval_items)""")
def loss_mask(s, d):
    w = X.tokens(F.col("text"))
    masked = F.transform(w, lambda x, i: F.when(i < 6, F.lit(-100)).otherwise(F.length(x)))
    return table(s, d, "eval_items").select("item_id", F.aggregate(masked, F.lit(0), lambda a, x: a + x).cast("long").alias("total"))


@query("r40_failures", "R40", r"""
with p as (select distinct id, source_question q, prediction p from predictions where source_question is not null and prediction is not null),
t as (select id, p, q, list_distinct(list_filter(regexp_extract_all(lower(q),'[a-z0-9]+'), x -> length(x)>3)) k, len(regexp_extract_all(p,'[^\s]+')) n, len(regexp_extract_all(q,'[^\s]+')) m from p)
select id, array_to_string(list_filter([case when regexp_matches(lower(p),'which of the following|in this context|as described above') then 'GENERIC_TEMPLATE' end, case when len(k)>0 and len(list_filter(k, x -> contains(lower(p),x)))/len(k)::double<0.5 then 'LOW_TOPIC_OVERLAP' end, case when n>greatest(35,5*m) then 'OVER_GENERATION' end, case when p='' then 'EMPTY_OUTPUT' end], x -> x is not null),';') as failures from t""")
def failures(s, d):
    p = table(s, d, "predictions").filter("source_question is not null and prediction is not null").select("id", F.col("source_question").alias("q"), F.col("prediction").alias("p")).distinct()
    low = F.lower("p")
    words = lambda c: F.size(F.regexp_extract_all(c, F.lit(r"[^\s]+"), F.lit(0)))
    p = p.withColumn("k", F.array_distinct(F.filter(X.tokens(F.col("q")), lambda w: F.length(w) > 3)))
    low_overlap = (F.size("k") > 0) & (F.size(F.filter("k", lambda w: F.lower("p").contains(w))) / F.size("k") < 0.5)
    found = F.array(F.when(low.rlike("which of the following|in this context|as described above"), "GENERIC_TEMPLATE"), F.when(low_overlap, "LOW_TOPIC_OVERLAP"), F.when(words("p") > F.greatest(F.lit(35), 5 * words("q")), "OVER_GENERATION"), F.when(F.col("p") == "", "EMPTY_OUTPUT"))
    return p.select("id", F.array_join(F.array_compact(found), ";").alias("failures"))


@query("t05_concept_ratio", "P3 T5 T13", f"""
with i as (select distinct unnest({_TOK}) t from eval_items), p as (select list(t) ps from i where length(t)>=3 and not list_contains({_sql_list(X.CONCEPT_STOPWORDS)},t)),
d as (select doc_id, list_distinct(list_filter({_TOK}, x -> length(x)>=3 and not list_contains({_sql_list(X.CONCEPT_STOPWORDS)},x))) b from documents where text is not null)
select doc_id, len(b)::bigint as concepts, round(len(list_intersect(b,ps))/greatest(1,len(b))::double,6) as ratio from d, p""")
def concept_ratio(s, d):
    return _concept_ratio(table(s, d, "eval_items"), table(s, d, "documents"))


def _concept_ratio(items, docs):
    """The protected vocabulary is joined by term, so it never has to fit in one row."""
    keep = lambda w: (F.length(w) >= 3) & ~F.array_contains(X.array_of(X.CONCEPT_STOPWORDS), w)
    p = term_counts(items, "item_id").select("t", F.lit(1).alias("k")).distinct()
    b = docs.filter("text is not null").select("doc_id", F.explode_outer(F.array_distinct(F.filter(X.tokens(F.col("text")), keep))).alias("t"))
    return b.join(p, "t", "left").groupBy("doc_id").agg(F.count("t").alias("concepts"), F.round(F.sum(F.coalesce("k", F.lit(0))) / F.greatest(F.lit(1), F.count("t")), 6).alias("ratio"))


@query("a33_guard_rates", "A33", r"""
with t as (select distinct turn_id, lower(trim(coalesce(role,'unknown'))) role, lower(coalesce(content,'')) c from chat_turns), h as (select role, (regexp_matches(c,'\bcopy\b|\bquote\b|\bverbatim\b')::int + regexp_matches(c,'\bexam\b|\bpaper\b|\bquestions?\b')::int) hits from t)
select role, count(*)::bigint as n, sum((hits>=2)::int)::bigint as blocked, round(avg((hits>=2)::int),6) as block_rate, round(avg(least(1.0,0.2*hits)),6) as mean_risk, round(1-avg((hits<2)::int),6) as false_block from h group by 1""")
def guard_rates(s, d):
    t = table(s, d, "chat_turns").select("turn_id", F.lower(F.trim(F.coalesce("role", F.lit("unknown")))).alias("role"), F.lower(F.coalesce("content", F.lit(""))).alias("c")).distinct()
    hits = F.col("c").rlike(r"\bcopy\b|\bquote\b|\bverbatim\b").cast("int") + F.col("c").rlike(r"\bexam\b|\bpaper\b|\bquestions?\b").cast("int")
    h = t.select("role", hits.alias("hits"))
    on = (F.col("hits") >= 2).cast("int")
    return h.groupBy("role").agg(F.count("*").alias("n"), F.sum(on).alias("blocked"), F.round(F.avg(on), 6).alias("block_rate"), F.round(F.avg(F.least(F.lit(1.0), 0.2 * F.col("hits"))), 6).alias("mean_risk"), F.round(1 - F.avg(1 - on), 6).alias("false_block"))


@query("w25_answer_window", "W25 R36", """
with p as (select distinct id, context c, reference a, strpos(context,reference) s from predictions where task='qa' and context is not null and reference is not null and strpos(context,reference)>0), r as (select *, unnest([400,200,100,50,25,0]) r from p),
w as (select id, r, greatest(1,s-r) b, least(length(c), s+length(a)-1+r) e from r)
select id, max(r)::bigint as radius, max_by(e-b+1, r)::bigint as chars from w where e-b+1<=180 or r=0 group by id""")
def answer_window(s, d):
    """The widest halved radius whose window around the answer fits the budget."""
    p = table(s, d, "predictions").filter("task = 'qa' and context is not null and reference is not null").select("id", "context", "reference").distinct()
    p = p.withColumn("s", F.position(F.col("reference"), F.col("context"))).filter("s > 0")
    w = p.select("id", F.explode(F.array(*[F.lit(x) for x in (400, 200, 100, 50, 25, 0)])).alias("r"), "s", F.length("context").alias("n"), F.length("reference").alias("m"))
    size = F.least(F.col("n"), F.col("s") + F.col("m") - 1 + F.col("r")) - F.greatest(F.lit(1), F.col("s") - F.col("r")) + 1
    w = w.withColumn("k", size).filter("k <= 180 or r = 0")
    return w.groupBy("id").agg(F.max("r").cast("long").alias("radius"), F.max_by("k", "r").cast("long").alias("chars"))


@query("w27_template_choice", "W27", """
with q as (select distinct id, lower(trim(target_bloom_level)) lvl from predictions where task='bloom_rewrite' and target_bloom_level is not null), r as (select id, lvl, (row_number() over(partition by lvl order by md5(id), id)-1)%4 t from q)
select lvl as level, t::bigint as template, count(*)::bigint as n from r group by all""")
def template_choice(s, d):
    from spindrift.operators.partition import dealt

    q = table(s, d, "predictions").filter("task = 'bloom_rewrite' and target_bloom_level is not null").select("id", F.lower(F.trim("target_bloom_level")).alias("level")).distinct()
    return dealt(q, "id", "level", 4).groupBy("level", F.col("hand").cast("long").alias("template")).agg(F.count("*").alias("n"))


@query("t29_summary_cleaned", "T29 T28", r"""
with p as (select distinct id, prediction p from predictions where task='summarization' and prediction is not null)
select id, case when regexp_matches(trim(p),'(?i)\b(the|a|an|and|of|to|with|for|in)$') then 'dangling' when not regexp_matches(trim(p),'[.!?]$') then 'open' else 'closed' end as ending, md5(trim(regexp_replace(p,'\[[0-9]+\]\s*','','g'))) as cleaned from p""")
def summary_cleaned(s, d):
    p = table(s, d, "predictions").filter("task = 'summarization' and prediction is not null").select("id", F.col("prediction").alias("p")).distinct()
    t = F.trim("p")
    ending = F.when(t.rlike(r"(?i)\b(the|a|an|and|of|to|with|for|in)\z"), "dangling").when(~t.rlike(r"[.!?]\z"), "open").otherwise("closed")
    return p.select("id", ending.alias("ending"), F.md5(F.trim(F.regexp_replace("p", r"\[[0-9]+\]\s*", ""))).alias("cleaned"))


@query("n28_budget_ratio", "N28 R13 R14", """
with c as (select user_id%7 client, count(*) n, sum((value>0)::int) done from events group by 1), t as (select client, n, coalesce(nullif(done,0),n) actual from c)
select client, n::bigint as planned, actual::bigint as actual, round(actual/n::double,4) as ratio, (3*ceil(n/64.0))::bigint as steps, sum(actual) over ()::bigint as total from t""")
def budget_ratio(s, d):
    c = table(s, d, "events").groupBy((F.col("user_id") % 7).alias("client")).agg(F.count("*").alias("planned"), F.count_if(F.col("value") > 0).alias("done"))
    a = c.withColumn("actual", F.coalesce(F.nullif("done", F.lit(0)), "planned"))
    return a.select("client", "planned", "actual", F.round(F.try_divide("actual", "planned"), 4).alias("ratio"), (3 * F.ceil(F.col("planned") / 64.0)).alias("steps"), F.sum("actual").over(W.partitionBy()).alias("total"))  # seven rows


@query("pr13_verbatim_rewrites", "T35")
def verbatim(s, d):
    """(id, ratio, verbatim): rewrites whose text after the first word is the question's, by difflib's ratio."""
    from spindrift.operators.sequences import sequence_ratio

    p = table(s, d, "predictions").filter("task = 'bloom_rewrite' and prediction is not null and source_question is not null").select("id", "source_question", "prediction").distinct()
    tail = lambda c: F.regexp_replace(X.normalize(F.col(c)), r"^\S+ ", "")
    p = p.select("id", tail("source_question").alias("a"), tail("prediction").alias("b"), X.jaccard(X.token_set(F.col("source_question")), X.token_set(F.col("prediction"))).alias("j"))
    # A ratio of 0.94 needs nearly all words in common; the cheap test in the JVM spares Python the rest.
    near = sequence_ratio(p.filter("j >= 0.6"), "a", "b").select("id", F.round("ratio", 6).alias("ratio"))
    return p.select("id").join(near, "id", "left").select("id", "ratio", (F.coalesce("ratio", F.lit(0.0)) >= 0.94).alias("verbatim"))


@query("n03_perturbed_queries", "N3")
def perturbed(s, d):
    """(vec_id, shift): how far a query vector moves by noise seeded from its own hash."""
    import hashlib

    import numpy as np
    import pandas as pd

    def move(frames):
        for pdf in frames:
            out = []
            for i, v in zip(pdf["vec_id"], pdf["embedding"]):
                seed = int.from_bytes(hashlib.sha256(f"7:{i}".encode()).digest()[:8], "little") % 2**32
                w = np.asarray(v, np.float64) + np.random.default_rng(seed).normal(0.0, 0.02, len(v))
                out.append((i, round(float(np.linalg.norm(w / max(np.linalg.norm(w), 1e-12) - v)), 6)))
            yield pd.DataFrame(out, columns=["vec_id", "shift"])

    return table(s, d, "embeddings").select("vec_id", "embedding").mapInPandas(move, "vec_id long, shift double")
