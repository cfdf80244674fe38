"""Dataset quality, splits and sampling queries (A24 to A32, W15 to W26, G rows, J2 to J6, S16)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.functions import text as X
from spindrift.operators import partition as P
from spindrift.plans.registry import query
from spindrift.plans.text import _TOK
from spindrift.runtime import cut, table

_NORM = "trim(regexp_replace(lower(text),'[^a-z0-9]+',' ','g'))"


@query("a24_duplicates", "A24", f"""
select source, lang, count(*)::bigint as n, (count(text)-count(distinct text))::bigint as exact_surplus, (count(text)-count(distinct {_NORM}))::bigint as normal_surplus, sum((text is null)::int)::bigint as nulls, sum((length(text)<200)::int)::bigint as short from documents group by all""")
def duplicates(s, d):
    """Surplus copies by source and language; texts are told apart by hashes of 128 bits, so no text is shuffled for a count."""
    t = table(s, d, "documents").select("source", "lang", F.md5("text").alias("a"), F.md5(X.normalize(F.col("text"))).alias("b"), F.length("text").alias("n"))
    return t.groupBy("source", "lang").agg(
        F.count("*").alias("n"), (F.count("a") - F.countDistinct("a")).alias("exact_surplus"), (F.count("a") - F.countDistinct("b")).alias("normal_surplus"),
        F.count_if(F.col("a").isNull()).alias("nulls"), F.sum((F.col("n") < 200).cast("int")).alias("short"),
    )


@query("a25_label_spine", "A25 R17", """
with s as (select distinct source from documents), l as (select distinct content_type from documents), g as (select source, content_type, count(*) n from documents group by all)
select source, content_type, coalesce(n,0)::bigint as n, round(coalesce(n,0)/sum(coalesce(n,0)) over (partition by source)::double,6) as share from s, l left join g using(source, content_type)""".replace("from s, l left join", "from (select * from s, l) left join"))
def label_spine(s, d):
    t = table(s, d, "documents")
    g = t.groupBy("source", "content_type").agg(F.count("*").alias("n"))
    types = g.groupBy().agg(F.collect_set("content_type").alias("types"))  # the label set
    spine = g.select("source").distinct().join(F.broadcast(types)).select("source", F.explode("types").alias("content_type"))
    j = spine.join(g, ["source", "content_type"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return j.select("source", "content_type", "n", F.round(F.col("n") / F.sum("n").over(W.partitionBy("source")), 6).alias("share"))


@query("a26_class_weights", "A26 R15", "with g as (select label, count(*) c from embeddings group by 1) select label, c::bigint as n, round(greatest(1/3.0::double, least(3.0, sum(c) over ()/(count(*) over ()*c)::double)),6) as weight from g")
def class_weights(s, d):
    g = table(s, d, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    w = W.partitionBy()  # one row per label
    return g.select("label", "n", F.round(F.greatest(F.lit(1 / 3), F.least(F.lit(3.0), F.sum("n").over(w) / (F.count("*").over(w) * F.col("n")))), 6).alias("weight"))


@query("a27_majority_label", "A27 P25 R46", """
with p as (select distinct id, source_id, lower(trim(source_bloom_level)) l from predictions where source_id is not null and source_bloom_level is not null), g as (select source_id, l, count(*) n from p group by all)
select source_id, l as label, n::bigint as n from g qualify row_number() over(partition by source_id order by n desc, l)=1""")
def majority(s, d):
    p = table(s, d, "predictions").filter("source_id is not null and source_bloom_level is not null").select("id", "source_id", F.lower(F.trim("source_bloom_level")).alias("label")).distinct()
    g = p.groupBy("source_id", "label").agg(F.count("*").alias("n"))
    best = g.groupBy("source_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "label")).alias("b"))
    return best.select("source_id", F.col("b.label").alias("label"), (-F.col("b.m")).alias("n"))


@query("w15_round_robin", "W15 W17 R16", "select vec_id, label, ((row_number() over(partition by label order by md5(vec_id::varchar), vec_id)-1)%4)::bigint as hand from embeddings")
def round_robin(s, d):
    return P.dealt(table(s, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 4)


@query("w18_capped", "W18 W23 R38 J3", "select vec_id, label from embeddings qualify row_number() over(partition by label order by md5(vec_id::varchar), vec_id)<=7")
def capped(s, d):
    return P.capped(table(s, d, "embeddings").select("vec_id", "label"), "vec_id", "label", 7)


@query("w19_stratified_split", "W19 W20 A28", """
with n as (select label, count(*) n from embeddings group by 1), r as (select vec_id, label, row_number() over(partition by label order by md5(vec_id::varchar), vec_id) rank from embeddings)
select vec_id, label, case when rank<=round_even(0.7*n,0) then 'train' when rank<=round_even(0.7*n,0)+round_even(0.15*n,0) then 'validation' else 'test' end as split from r join n using(label)""")
def stratified(s, d):
    return P.stratified_split(table(s, d, "embeddings"), "vec_id", "label", 0.7, 0.15)


@query("w19_group_split", "W19 W20 A28", """
with p as (select distinct id, source_id g, lower(trim(target_bloom_level)) l from predictions where task='bloom_rewrite' and source_id is not null and target_bloom_level is not null), c as (select g, l, count(*) n from p group by all),
m as (select g, l from c qualify row_number() over(partition by g order by n desc, l)=1), r as (select g, l, row_number() over(partition by l order by md5(g), g) k, count(*) over(partition by l) n from m)
select g as source_id, l as label, case when k<=round_even(0.7*n,0) then 'train' when k<=round_even(0.7*n,0)+round_even(0.15*n,0) then 'validation' else 'test' end as split, 1::bigint as splits from r""")
def group_split(s, d):
    """Groups by their majority label, 70/15/15 in hash order; ``splits`` is the number of splits that a group's rows have: one."""
    p = table(s, d, "predictions").filter("task = 'bloom_rewrite' and source_id is not null and target_bloom_level is not null").select("id", "source_id", F.lower(F.trim("target_bloom_level")).alias("l")).distinct()
    m = p.groupBy("source_id", "l").agg(F.count("*").alias("n")).groupBy("source_id").agg(F.min(F.struct((-F.col("n")).alias("n"), "l")).alias("x")).select("source_id", F.col("x.l").alias("label"))
    g = P.stratified_split(m, "source_id", "label", 0.7, 0.15)
    held = p.join(g.select("source_id", "split"), "source_id").groupBy("source_id").agg(F.countDistinct("split").alias("splits"))
    return g.join(held, "source_id").select("source_id", "label", "split", "splits")


@query("w21_balanced", "W21 W22", """
with m as (select min(c) m from (select count(*) c from embeddings group by label)), r as (select vec_id, label, row_number() over(partition by label order by md5(vec_id::varchar), vec_id) rank from embeddings) select vec_id, label from r, m where rank<=m""")
def balanced(s, d):
    t = table(s, d, "embeddings").select("vec_id", "label")
    least = P.group_sizes(t, ["label"], "c").agg(F.min("c").alias("m"))
    return P.hash_rank(t, ["label"], F.md5(F.col("vec_id").cast("string")), "vec_id").join(F.broadcast(least)).filter("rank <= m").select("vec_id", "label")  # one row


@query("w16_dirichlet", "W16")
def dirichlet(s, d):
    return P.dirichlet_clients(table(s, d, "embeddings"), "vec_id", "label", 5, 0.5)


@query("w24_context_split", "W24", """
with g as (select source_id, count(distinct id) n from predictions where source_id is not null group by 1), r as (select source_id, n, coalesce(sum(n) over(order by md5(source_id), source_id rows between unbounded preceding and 1 preceding),0) prior, sum(n) over () total from g)
select source_id, n::bigint as n, case when prior<0.95*total then 'train' else 'validation' end as split from r""")
def context_split(s, d):
    """Running totals by hash slot first, then within a slot, so the order is global without one task sorting all."""
    g = table(s, d, "predictions").filter("source_id is not null").groupBy("source_id").agg(F.countDistinct("id").alias("n"))
    g = g.withColumn("h", F.md5("source_id")).withColumn("slot", F.substring("h", 1, 2))
    slots = g.groupBy("slot").agg(F.sum("n").alias("sn"))  # at most 256 rows
    w = W.partitionBy().orderBy("slot")
    before = slots.select("slot", (F.sum("sn").over(w) - F.col("sn")).alias("before"), F.sum("sn").over(W.partitionBy()).alias("total"))
    run = W.partitionBy("slot").orderBy("h", "source_id").rowsBetween(W.unboundedPreceding, 0)
    prior = F.sum("n").over(run) - F.col("n") + F.col("before")
    return g.join(F.broadcast(before), "slot").select("source_id", "n", F.when(prior < 0.95 * F.col("total"), "train").otherwise("validation").alias("split"))


@query("j06_split_overlap", "J6 G2 R42", f"""
with t as (select doc_id, {_NORM} n, ('0x'||sha256(doc_id::varchar)[1:8])::bigint%3 k from documents where text is not null ), p as (select distinct n, k from t)
select a.k as split_a, b.k as split_b, count(*)::bigint as shared from p a join p b on a.n=b.n and a.k<b.k group by all""")
def split_overlap(s, d):
    t = table(s, d, "documents").filter("text is not null")
    p = t.select(F.xxhash64(X.normalize(F.col("text"))).alias("n"), F.md5(X.normalize(F.col("text"))).alias("m"), X.bucket(F.col("doc_id").cast("string"), 3).alias("k")).distinct()
    a, b = p.select("n", "m", F.col("k").alias("split_a")), p.select("n", "m", F.col("k").alias("split_b"))
    return a.join(b, ["n", "m"]).filter("split_a < split_b").groupBy("split_a", "split_b").agg(F.count("*").alias("shared"))


@query("j02_run_overlap", "J2 J3", """
with a as (select distinct source_question q from predictions where run_id='run-base-fp16' and source_question is not null), b as (select distinct source_question q from predictions where run_id='run-base-q8' and source_question is not null)
select case when a.q is null then 'second' when b.q is null then 'first' else 'both' end as side, count(*)::bigint as questions from a full join b on a.q=b.q group by 1""")
def run_overlap(s, d):
    p = table(s, d, "predictions").filter("source_question is not null")
    one = lambda r, c: p.filter(F.col("run_id") == r).select("source_question").distinct().withColumn(c, F.lit(1))
    j = one("run-base-fp16", "x").join(one("run-base-q8", "y"), "source_question", "full")
    return j.groupBy(F.when(F.col("x").isNull(), "second").when(F.col("y").isNull(), "first").otherwise("both").alias("side")).agg(F.count("*").alias("questions"))


@query("j05_review_gaps", "J5 R35", """
with a as (select distinct annotator from doc_labels), d as (select distinct doc_id from doc_labels), l as (select doc_id, annotator, max(quality) q from doc_labels group by all)
select a.annotator, count(*)::bigint as documents, sum((q is null)::int)::bigint as missing from d, a left join l on l.doc_id=d.doc_id and l.annotator=a.annotator group by 1""".replace("from d, a left join l on l.doc_id=d.doc_id and l.annotator=a.annotator group by 1", "from (select * from d, a) a left join l on l.doc_id=a.doc_id and l.annotator=a.annotator group by 1"))
def review_gaps(s, d):
    t = table(s, d, "doc_labels")
    annotators = t.groupBy().agg(F.collect_set("annotator").alias("a"))  # the few annotators
    spine = t.select("doc_id").distinct().join(F.broadcast(annotators)).select("doc_id", F.explode("a").alias("annotator"))
    lab = t.groupBy("doc_id", "annotator").agg(F.max("quality").alias("q"))
    return spine.join(lab, ["doc_id", "annotator"], "left").groupBy("annotator").agg(F.count("*").alias("documents"), F.count_if(F.col("q").isNull()).alias("missing"))


@query("a29_templates", "A29", """
with p as (select distinct id, prediction from predictions where task='bloom_rewrite' and prediction is not null), t as (select array_to_string((regexp_extract_all(lower(prediction),'[a-z0-9]+'))[1:5],' ') opening from p), g as (select opening, count(*) n from t group by 1)
select opening, n::bigint as n from g""")
def templates(s, d):
    p = table(s, d, "predictions").filter("task = 'bloom_rewrite' and prediction is not null").select("id", "prediction").distinct()
    return p.groupBy(F.array_join(F.slice(X.tokens(F.col("prediction")), 1, 5), " ").alias("opening")).agg(F.count("*").alias("n"))


@query("a30_gram_coverage", "A30", f"""
with p as (select distinct id, prediction text, (('0x'||md5(id)[1:8])::bigint%5=0) test from predictions where prediction is not null and id is not null), w as (select id, test, {_TOK} w from p), g as (select distinct id, test, array_to_string(w[i:i+3],' ') gram from (select id, test, w, unnest(case when len(w)>=4 then range(1,len(w)-2) else [] end) i from w)),
t as (select distinct gram from g where not test), x as (select id, avg((t.gram is not null)::int) c from g left join t using(gram) where test group by 1)
select count(*)::bigint as texts, round(avg(c),5) as coverage from x""")
def gram_coverage(s, d):
    """Of the predictions that a hash puts into the test split, the mean share of 4-grams that the others hold."""
    test = F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long") % 5 == 0
    p = table(s, d, "predictions").filter("prediction is not null and id is not null").select("id", test.alias("test"), "prediction").distinct()
    g = p.select("id", "test", F.explode(X.ngram_set(X.tokens(F.col("prediction")), 4)).alias("gram"))
    train = g.filter("not test").select("gram", F.lit(1).alias("seen")).distinct()
    x = g.filter("test").join(train, "gram", "left").groupBy("id").agg(F.avg(F.coalesce("seen", F.lit(0))).alias("c"))
    return x.agg(F.count("*").alias("texts"), F.round(F.avg("c"), 5).alias("coverage"))


@query("g06_cross_templates", "G6", r"""
with p as (select distinct id, regexp_replace(lower(source_question),'the [a-z]+ [a-z]+','<topic>','g') t, run_id from predictions where source_question is not null)
select t as template, count(distinct run_id)::bigint as runs, count(*)::bigint as n from p group by 1 having count(distinct run_id)>1""")
def cross_templates(s, d):
    t = F.regexp_replace(F.lower("source_question"), "the [a-z]+ [a-z]+", "<topic>")
    p = table(s, d, "predictions").filter("source_question is not null").select("id", t.alias("template"), "run_id").distinct()
    return p.groupBy("template").agg(F.countDistinct("run_id").alias("runs"), F.count("*").alias("n")).filter("runs > 1")


@query("pr09_usable", "P9 P10", r"""
with p as (select distinct id, source_question q from predictions), r as (select case when q is null or trim(q)='' then 'missing' when len(regexp_extract_all(q,'[^\s]+'))<6 then 'too_short' when len(regexp_extract_all(q,'[^\s]+'))>30 then 'too_long' when length(q)-length(replace(q,'?',''))>3 then 'many_questions' when not regexp_matches(trim(q),'[.?!]$') then 'incomplete' else 'ok' end reason from p)
select reason, count(*)::bigint as n from r group by 1""")
def usable(s, d):
    q = F.col("source_question")
    words = F.size(F.regexp_extract_all(q, F.lit(r"[^\s]+"), F.lit(0)))
    reason = F.when(q.isNull() | (F.trim(q) == ""), "missing").when(words < 6, "too_short").when(words > 30, "too_long").when(F.length(q) - F.length(F.replace(q, F.lit("?"), F.lit(""))) > 3, "many_questions").when(~F.trim(q).rlike("[.?!]$"), "incomplete").otherwise("ok")
    return table(s, d, "predictions").select("id", "source_question").distinct().groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("pr12_validated", "P12", """
with p as (select distinct id, prediction r, format_valid f, topic_preserved t, trivial_transform v, cognitive_valid c from predictions where task='bloom_rewrite'),
x as (select id, list_filter([case when regexp_matches(coalesce(r,''),'^ *$') then 'empty_output' end, case when not coalesce(f,false) then 'invalid_question_format' end, case when not coalesce(t,false) then 'topic_drift' end, case when coalesce(v,false) then 'trivial_verb_swap' end, case when not coalesce(c,false) then 'cognitive_invalid' end], x -> x is not null) l from p)
select id, len(l)=0 as accepted, array_to_string(l,';') as reasons from x""")
def validated(s, d):
    p = table(s, d, "predictions").filter("task = 'bloom_rewrite'").select("id", F.col("prediction").alias("r"), "format_valid", "topic_preserved", "trivial_transform", "cognitive_valid").distinct()
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False))
    found = F.array_compact(F.array(F.when(F.coalesce("r", F.lit("")).rlike(r"\A *\z"), "empty_output"), F.when(no("format_valid"), "invalid_question_format"), F.when(no("topic_preserved"), "topic_drift"), F.when(~no("trivial_transform"), "trivial_verb_swap"), F.when(no("cognitive_valid"), "cognitive_invalid")))
    return p.select("id", (F.size(found) == 0).alias("accepted"), F.array_join(found, ";").alias("reasons"))


@query("pr17_repeated_wording", "P17", f"""
with p as (select distinct diag_id, cleaned_output text from target_rewrite_diagnostic where cleaned_output is not null), w as (select diag_id, {_TOK} w from p), g as (select diag_id, array_to_string(w[i:i+3],' ') gram, i from (select diag_id, w, unnest(case when len(w)>=4 then range(1,len(w)-2) else [] end) i from w)), r as (select diag_id, gram from g group by all having max(i)-min(i)>=6)
select diag_id, count(*)::bigint as repeats from r group by 1""")
def repeated(s, d):
    p = table(s, d, "target_rewrite_diagnostic").filter("cleaned_output is not null").select("diag_id", "cleaned_output").distinct()
    g = p.select("diag_id", F.posexplode(X.ngrams(X.tokens(F.col("cleaned_output")), 4)).alias("i", "gram"))
    r = g.groupBy("diag_id", "gram").agg((F.max("i") - F.min("i")).alias("gap")).filter("gap >= 6")
    return r.groupBy("diag_id").agg(F.count("*").alias("repeats"))


@query("s16_violations", "S16", """
select 'predictions' as tbl, 'duplicate_id' as violation, (select count(*)::bigint from (select id from predictions group by 1 having count(distinct coalesce(prediction,'')) > 1)) as n
union all select 'predictions', 'unknown_run', (select count(*)::bigint from predictions where run_id not in (select run_id from eval_runs))
union all select 'documents', 'wrong_n_chars', (select count(*)::bigint from documents where n_chars<>length(text))
union all select 'doc_labels', 'unknown_document', (select count(*)::bigint from doc_labels where doc_id not in (select doc_id from documents))""")
def violations(s, d):
    """Violation counts; an all-zero result is a pass."""
    p, docs = table(s, d, "predictions"), table(s, d, "documents")
    twice = p.groupBy("id").agg(F.countDistinct(F.coalesce("prediction", F.lit(""))).alias("k")).filter("k > 1")
    lost = p.join(table(s, d, "eval_runs"), "run_id", "left_anti").filter("run_id is not null")
    wrong = docs.filter(F.col("n_chars") != F.length("text"))
    orphan = table(s, d, "doc_labels").join(docs, "doc_id", "left_anti").filter("doc_id is not null")
    out = None
    for tbl, name, df in (("predictions", "duplicate_id", twice), ("predictions", "unknown_run", lost), ("documents", "wrong_n_chars", wrong), ("doc_labels", "unknown_document", orphan)):
        row = df.agg(F.count("*").alias("n")).select(F.lit(tbl).alias("tbl"), F.lit(name).alias("violation"), "n")
        out = row if out is None else out.union(row)
    return out


@query("n22_dataset_hash", "N22 N21 N27", "select source, count(*)::bigint as n, bit_xor(('0x'||md5(doc_id::varchar||'|'||coalesce(text,''))[1:15])::bigint)::bigint as h from documents group by 1")
def dataset_hash(s, d):
    """Order-insensitive: the exclusive or of row hashes combines before the shuffle, whatever the size."""
    h = F.conv(F.substring(F.md5(F.concat(F.col("doc_id").cast("string"), F.lit("|"), F.coalesce("text", F.lit("")))), 1, 15), 16, 10).cast("long")
    return table(s, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.bit_xor(h).alias("h"))


def _normal_questions(s, d):
    """(question, k, text): every distinct question with its normalized form and the form's key."""
    p = table(s, d, "predictions").filter("source_question is not null").select("source_question").distinct()
    p = p.select(F.md5("source_question").alias("question"), X.normalize(F.col("source_question")).alias("text"))
    return p.select("question", F.md5("text").alias("k"), "text")


@query("j07_question_pairs", "J7 T35")
def question_pairs(s, d):
    """(a, b, likeness, ratio) of all normalized questions: alike by words, or by difflib's ratio from the earlier to the later key."""
    return _question_pairs(_normal_questions(s, d).select("k", "text").distinct())


def _question_pairs(texts):
    from spindrift.operators.sequences import ratio_candidates, sequence_ratio

    w = cut(texts.select("k", "text", F.transform(X.content_tokens(F.col("text"), X.GROUPING_STOPWORDS), lambda t: F.xxhash64(t)).alias("t")))
    many = w.filter(F.size("t") >= 4)
    df = many.select(F.explode("t").alias("w")).groupBy("w").agg(F.count("*").alias("n"))
    # 128 bits of which every token turns one, so sets differ in no fewer tokens than bits.
    turned = lambda half: F.aggregate("t", F.lit(0).cast("long"), lambda x, w: F.when(F.shiftright(w, 6).bitwiseAND(1) == half, x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), w.bitwiseAND(63).cast("int")))).otherwise(x))
    # Prefixes of the rarest tokens: alike sets share two of them, and one of a prefix less by one. Two meet in far fewer sets; of
    # long prefixes they would be too many. Sizes differ by a fifth at most, so up to 40 or above 32 both sets have the same kind of key.
    toks = many.select("k", F.size("t").alias("m"), turned(0).alias("s"), turned(1).alias("z"), F.explode("t").alias("w")).join(df, "w")
    order = W.partitionBy("k").orderBy("n", "w")
    own = F.col("m") - F.ceil(0.8 * F.col("m") - 1e-9) + 1
    pre = toks.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= own + 1).withColumn("before", F.collect_list("w").over(order.rowsBetween(W.unboundedPreceding, -1)))
    twos = F.when(F.col("m") <= 40, F.transform("before", lambda x: F.xxhash64(x, F.col("w"))))
    ones = F.when((F.col("m") > 32) & (F.col("r") <= own), F.array("w"))
    none = F.array().cast("array<long>")
    pre = cut(pre.select("k", F.explode(F.concat(F.coalesce(twos, none), F.coalesce(ones, none))).alias("w"), "m", "r", "s", "z"))
    ends = lambda x: [F.col("k").alias(x), "w", *(F.col(c).alias(f"{c}{x}") for c in "mrsz")]
    # Tokens before, at and behind the place where two sets meet must still hold 4/9 of the sizes' sum, and the rest is all that may differ.
    reach = F.least(F.col("ma") - F.col("ra"), F.col("mb") - F.col("rb")) + F.least("ra", "rb")
    differ = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb"))) + F.bit_count(F.col("za").bitwiseXOR(F.col("zb")))
    both = F.col("ma") + F.col("mb")
    met = pre.select(*ends("a")).join(pre.select(*ends("b")), "w").filter("a < b").filter(reach >= both * 0.8 / 1.8 - 1e-9).filter(differ <= both / 9 + 1e-9)
    alike = met.select("a", "b").distinct()
    near = ratio_candidates(w.filter("text != ''").select("k", "text"), 0.9)
    c = alike.withColumn("near", F.lit(False)).union(near.withColumn("near", F.lit(True))).groupBy("a", "b").agg(F.max("near").alias("near"))
    x = c.join(w.select(F.col("k").alias("a"), F.col("text").alias("qa"), F.col("t").alias("ta")), "a").join(w.select(F.col("k").alias("b"), F.col("text").alias("qb"), F.col("t").alias("tb")), "b")
    family = (F.size("ta") >= 4) & (F.size("tb") >= 4) & (F.col("likeness") >= 0.8)
    x = x.withColumn("likeness", X.jaccard(F.col("ta"), F.col("tb"))).withColumn("family", family).filter("family or near")
    gap = F.abs(F.length("qa") - F.length("qb"))
    x = x.filter(F.col("family") | (F.col("likeness") >= 0.25) | (gap <= 12)).select("a", "b", "likeness", "family", "qa", "qb")
    return sequence_ratio(x, "qa", "qb").filter("family or ratio >= 0.9").select("a", "b", F.round("likeness", 6).alias("likeness"), F.round("ratio", 6).alias("ratio"))


@query("j07_question_families", "J7 T35 G1")
def families(s, d):
    """(question, family): components of the pairs; a family is named by its smallest question, and a question without a like one is its own."""
    from spindrift.operators.components import components

    q = _normal_questions(s, d)
    node = lambda c: F.xxhash64(c)
    edges = _question_pairs(q.select("k", "text").distinct()).select(node("a").alias("u"), node("b").alias("v"))
    x = q.select("question", node("k").alias("node")).join(components(edges), "node", "left").select("question", F.coalesce("root", "node").alias("root"))
    return x.join(x.groupBy("root").agg(F.min("question").alias("family")), "root").select("question", "family")


@query("w07_merged_sources", "W7")
def merged(s, d):
    from spindrift.operators.sequences import merge_overlaps

    return merge_overlaps(table(s, d, "document_chunks"))


@query("n12_hashed_features", "N9 N11 N12")
def hashed(s, d):
    from spindrift.operators.sequences import hashed_features

    e = hashed_features(table(s, d, "eval_items").select(F.col("item_id").alias("id"), "text"))
    return e.select("id", F.size("features").alias("features"))
