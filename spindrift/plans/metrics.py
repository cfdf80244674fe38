"""Metric queries (A rows)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from spindrift.operators import metrics as M
from spindrift.plans.registry import query
from spindrift.runtime import table

LEVELS = ["Remember", "Understand", "Apply", "Analyze", "Evaluate", "Create"]
_LEVELS_SQL = "(values ('remember',0),('understand',1),('apply',2),('analyze',3),('evaluate',4),('create',5)) l(label,code)"
_BASE = "(select distinct id, run_id, lower(trim(target_bloom_level)) gold, lower(trim(classifier_prediction)) pred, classifier_confidence conf, fully_validated ok, target_match, failure_category, lower(trim(source_bloom_level)) src from predictions where task='bloom_rewrite' and target_bloom_level is not null and classifier_prediction is not null and classifier_prediction<>'')"


def _base(s, d):
    low = lambda c: F.lower(F.trim(F.col(c)))
    p = table(s, d, "predictions").filter("task = 'bloom_rewrite' and target_bloom_level is not null and classifier_prediction is not null and classifier_prediction <> ''")
    return p.select("id", "run_id", low("target_bloom_level").alias("gold"), low("classifier_prediction").alias("pred"), F.col("classifier_confidence").alias("conf"), F.col("fully_validated").alias("ok"), "target_match", "failure_category", low("source_bloom_level").alias("src")).distinct()


def _codes(s):
    return s.createDataFrame([(x.lower(), i) for i, x in enumerate(LEVELS)], "label string, code int")


@query("a01_confusion", "A1 A50 R28", f"select gold, pred as predicted, count(*)::bigint as n from {_BASE} group by all")
def confusion(s, d):
    return M.confusion(_base(s, d), "gold", "pred")


@query("a02_class_report", "A3", f"""
with b as {_BASE}, c as (select label, sum((gold=label and pred=label)::int) tp, sum((gold=label)::int) g, sum((pred=label)::int) p from b, {_LEVELS_SQL} group by 1),
m as (select label, case when p=0 then 0.0 else tp/p::double end pr, case when g=0 then 0.0 else tp/g::double end re, g from c)
select label, round(pr,6) as precision, round(re,6) as recall, round(case when pr+re=0 then 0.0 else 2*pr*re/(pr+re) end,6) as f1, g::bigint as support from m""")
def class_report(s, d):
    r = M.class_report(M.confusion(_base(s, d), "gold", "pred"), _codes(s))
    return r.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("a04_kappas", "A4", f"""
with b as (select l.code i, m.code j from {_BASE} b join {_LEVELS_SQL} on b.gold=l.label join {_LEVELS_SQL.replace(' l(', ' m(')} on b.pred=m.label),
c as (select i, j, count(*) n from b group by all), t as (select sum(n) n, sum(case when i=j then n else 0 end) a, sum(pow(i-j,2)/25.0*n) o from c),
r as (select i, sum(n) r from c group by 1), k as (select j, sum(n) k from c group by 1), e as (select sum(case when i=j then r*k else 0 end) ch, sum(pow(i-j,2)/25.0*r*k) e from r, k)
select n::bigint as n, round(a/n::double,6) as accuracy, round((a/n::double-ch/(n::double*n))/(1-ch/(n::double*n)),6) as kappa, round(1-o/(e/n::double),6) as weighted_kappa from t, e""")
def kappas(s, d):
    return M.kappas(M.confusion(_base(s, d), "gold", "pred"), _codes(s))


@query("a05_ordinal", "A5", f"""
with b as (select l.code i, m.code j from {_BASE} b join {_LEVELS_SQL} on b.gold=l.label join {_LEVELS_SQL.replace(' l(', ' m(')} on b.pred=m.label)
select count(*)::bigint as n, round(avg(abs(i-j)),6) as mean_distance, round(avg((abs(i-j)<=1)::int),6) as within_one, round(avg((abs(i-j)>=3)::int),6) as far from b""")
def ordinal(s, d):
    c = _codes(s)
    b = _base(s, d).join(F.broadcast(c.select(F.col("label").alias("gold"), F.col("code").alias("i"))), "gold").join(F.broadcast(c.select(F.col("label").alias("pred"), F.col("code").alias("j"))), "pred")  # six labels
    x = F.abs(F.col("i") - F.col("j"))
    return b.agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean_distance"), F.round(F.avg((x <= 1).cast("int")), 6).alias("within_one"), F.round(F.avg((x >= 3).cast("int")), 6).alias("far"))


_BIN_SQL = "(" + "+".join(f"(conf>={e!r}::double)::int" for e in M.EDGES[1:-1]) + ")"


@query("a06_calibration", "A6 A7", f"""
with b as (select {_BIN_SQL} bin, conf, (gold=pred)::int hit from {_BASE} where conf is not null), s as (select range b from range(10)), g as (select bin, count(*) n, avg(hit) acc, avg(conf) c from b group by 1)
select s.b::bigint as bin, coalesce(n,0)::bigint as n, round(acc,6) as accuracy, round(c,6) as confidence, round(coalesce(n*abs(acc-c)/sum(n) over (),0),6) as error from s left join g on s.b=g.bin""")
def calibration(s, d):
    b = _base(s, d).filter("conf is not null").select(M.calibration_bin(F.col("conf")).alias("bin"), "conf", (F.col("gold") == F.col("pred")).cast("int").alias("hit"))
    g = b.groupBy("bin").agg(F.count("*").alias("n"), F.avg("hit").alias("acc"), F.avg("conf").alias("c"))
    j = s.range(10).withColumnRenamed("id", "bin").join(g, "bin", "left")
    share = F.col("n") * F.abs(F.col("acc") - F.col("c")) / F.sum("n").over(W.partitionBy())  # ten rows
    return j.select("bin", F.coalesce("n", F.lit(0)).alias("n"), F.round("acc", 6).alias("accuracy"), F.round("c", 6).alias("confidence"), F.round(F.coalesce(share, F.lit(0.0)), 6).alias("error"))


@query("a08_selective", "A8", f"""
with b as {_BASE}, t as (select unnest([0.5,0.6,0.7,0.8,0.9])::double t)
select t as threshold, round(avg((conf>=t)::int),6) as coverage, round(avg(case when conf>=t then (gold=pred)::int end),6) as accuracy from b, t where conf is not null group by 1""")
def selective(s, d):
    b = _base(s, d).filter("conf is not null").select("conf", (F.col("gold") == F.col("pred")).cast("int").alias("hit"))
    t = b.withColumn("threshold", F.explode(F.array(*[F.lit(x) for x in (0.5, 0.6, 0.7, 0.8, 0.9)])))
    on = F.col("conf") >= F.col("threshold")
    return t.groupBy("threshold").agg(F.round(F.avg(on.cast("int")), 6).alias("coverage"), F.round(F.avg(F.when(on, F.col("hit"))), 6).alias("accuracy"))


_PAIR = "(select a.q, a.ok x, b.ok y from (select source_question q, max((lower(trim(target_bloom_level))=lower(trim(classifier_prediction)))::int) ok from predictions where run_id='run-base-fp16' and task='bloom_rewrite' and source_question is not null group by 1) a join (select source_question q, max((lower(trim(target_bloom_level))=lower(trim(classifier_prediction)))::int) ok from predictions where run_id='run-fedprox-q4' and task='bloom_rewrite' and source_question is not null group by 1) b using(q) where a.ok is not null and b.ok is not null)"


def _pair(s, d):
    p = table(s, d, "predictions").filter("task = 'bloom_rewrite' and source_question is not null")
    hit = (F.lower(F.trim("target_bloom_level")) == F.lower(F.trim("classifier_prediction"))).cast("int")
    one = lambda run, c: p.filter(F.col("run_id") == run).groupBy(F.col("source_question").alias("q")).agg(F.max(hit).alias(c))
    return one("run-base-fp16", "x").join(one("run-fedprox-q4", "y"), "q").filter("x is not null and y is not null")


@query("a09_mcnemar", "A9 A10 R24 A40", f"""
select count(*)::bigint as pairs, sum((x=1 and y=0)::int)::bigint as only_first, sum((x=0 and y=1)::int)::bigint as only_second, round(avg((x=y)::int),6) as agreement,
round(case when sum((x<>y)::int)=0 then 0.0 else pow(greatest(abs(sum((x=1 and y=0)::int)-sum((x=0 and y=1)::int))-1,0),2)/sum((x<>y)::int)::double end,6) as chi2,
round(least(1.0, 2*list_sum(list_transform(range(0, least(sum((x=1 and y=0)::int),sum((x=0 and y=1)::int))::bigint+1), i -> exp(lgamma(sum((x<>y)::int)+1)-lgamma(i+1)-lgamma(sum((x<>y)::int)-i+1)-sum((x<>y)::int)*ln(2))))),6) as exact_p from {_PAIR}""")
def mcnemar(s, d):
    b, c = F.count_if(F.expr("x = 1 and y = 0")), F.count_if(F.expr("x = 0 and y = 1"))
    chi = F.when(b + c == 0, 0.0).otherwise(F.pow(F.greatest(F.abs(b - c) - 1, F.lit(0)), 2) / (b + c))
    x = _pair(s, d).agg(F.count("*").alias("pairs"), b.alias("only_first"), c.alias("only_second"), F.round(F.avg(F.expr("cast(x = y as int)")), 6).alias("agreement"), F.round(chi, 6).alias("chi2"))
    # Twice the binomial tail up to the smaller count: the logarithm of each term follows from the one before.
    n, k = (F.col("only_first") + F.col("only_second")).cast("double"), F.least("only_first", "only_second")
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.lit(0.0).alias("s"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), k), start, lambda a, i: F.struct((a["t"] + F.log(F.greatest(n - i, F.lit(1.0)) / (i + 1))).alias("t"), (a["s"] + F.exp(a["t"])).alias("s")), lambda a: a["s"])
    return x.withColumn("exact_p", F.round(F.least(F.lit(1.0), 2 * tail), 6))


@query("a02_averages", "A2", f"""
with b as {_BASE}, c as (select label, sum((gold=label and pred=label)::int) tp, sum((gold=label)::int) g, sum((pred=label)::int) p from b, {_LEVELS_SQL} group by 1),
m as (select label, round(case when p=0 then 0.0 else tp/p::double end,6) pr, round(case when g=0 then 0.0 else tp/g::double end,6) re, case when p+g=0 then 0.0 else 2*tp/(p+g)::double end f, g from c)
select round(avg(pr),5) as macro_precision, round(avg(re),5) as macro_recall, round(avg(f),5) as macro_f1, round(sum(pr*g)/sum(g),5) as weighted_precision, round(sum(re*g)/sum(g),5) as weighted_recall, round(sum(f*g)/sum(g),5) as weighted_f1 from m""")
def class_averages(s, d):
    r = M.class_report(M.confusion(_base(s, d), "gold", "pred"), _codes(s)).withColumns({c: F.round(c, 6) for c in ("precision", "recall")})
    each = [x for c in ("precision", "recall", "f1") for x in (F.round(F.avg(c), 5).alias(f"macro_{c}"), F.round(F.sum(F.col(c) * F.col("support")) / F.sum("support"), 5).alias(f"weighted_{c}"))]
    return r.agg(*each)


@query("a34_sweep_area", "A34", f"""
with b as {_BASE}, t as (select unnest([0.0,0.4,0.5,0.6,0.7,0.8,0.9])::double t), g as (select t, avg((conf>=t)::int) x, coalesce(avg(case when conf>=t then (gold=pred)::int end),0) y from b, t where conf is not null group by 1),
l as (select t, x, y, lag(x) over(order by t desc) lx, lag(y) over(order by t desc) ly from g) select count(*)::bigint as thresholds, round(sum((x-lx)*(y+ly)/2),6) as area from l""")
def sweep_area(s, d):
    """Area under accuracy over coverage by trapezes between seven thresholds."""
    b = _base(s, d).filter("conf is not null").select("conf", (F.col("gold") == F.col("pred")).cast("int").alias("hit"))
    t = b.withColumn("t", F.explode(F.array(*[F.lit(x) for x in (0.0, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)])))
    on = F.col("conf") >= F.col("t")
    g = t.groupBy("t").agg(F.avg(on.cast("int")).alias("x"), F.coalesce(F.avg(F.when(on, F.col("hit"))), F.lit(0.0)).alias("y"))
    back = W.partitionBy().orderBy(F.desc("t"))  # seven rows
    g = g.withColumns({"lx": F.lag("x").over(back), "ly": F.lag("y").over(back)})
    return g.agg(F.count("*").alias("thresholds"), F.round(F.sum((F.col("x") - F.col("lx")) * (F.col("y") + F.col("ly")) / 2), 6).alias("area"))


@query("j01_last_wins", "J1", """
with p as (select distinct id, run_id, source_question q, evaluated_at, (lower(trim(target_bloom_level))=lower(trim(classifier_prediction)))::int ok from predictions where task='bloom_rewrite' and source_question is not null and id is not null),
a as (select * from p where run_id='run-base-fp16'), b as (select * from p where run_id='run-fedprox-q4' qualify row_number() over(partition by q order by evaluated_at desc nulls last, id desc)=1)
select a.id, b.id as other_id, a.ok as first_ok, b.ok as second_ok from a join b using(q)""")
def last_wins(s, d):
    """Predictions of one run with the other run's last prediction on the same question."""
    ok = (F.lower(F.trim("target_bloom_level")) == F.lower(F.trim("classifier_prediction"))).cast("int")
    p = table(s, d, "predictions").filter("task = 'bloom_rewrite' and source_question is not null and id is not null").select("id", "run_id", F.col("source_question").alias("q"), "evaluated_at", ok.alias("ok")).distinct()
    last = F.max(F.struct(F.coalesce("evaluated_at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("t"), "id", "ok"))
    b = p.filter("run_id = 'run-fedprox-q4'").groupBy("q").agg(last.alias("x")).select("q", F.col("x.id").alias("other_id"), F.col("x.ok").alias("second_ok"))
    return p.filter("run_id = 'run-base-fp16'").join(b, "q").select("id", "other_id", F.col("ok").alias("first_ok"), "second_ok")


@query("j15_missing_transitions", "J13 J15", f"""
with b as (select distinct run_id, lower(trim(source_bloom_level)) s, lower(trim(target_bloom_level)) t from predictions where task='bloom_rewrite'), l as (select * from {_LEVELS_SQL}), r as (select distinct run_id from b where run_id is not null)
select r.run_id, x.label as source, y.label as target from r, l x, l y where x.label<>y.label and not exists (select 1 from b where b.run_id=r.run_id and b.s=x.label and b.t=y.label)""")
def missing_transitions(s, d):
    low = lambda c: F.lower(F.trim(c))
    b = table(s, d, "predictions").filter("task = 'bloom_rewrite' and run_id is not null").select("run_id", low("source_bloom_level").alias("source"), low("target_bloom_level").alias("target")).distinct()
    c = [x.lower() for x in LEVELS]
    pairs = F.array(*[F.struct(F.lit(x).alias("source"), F.lit(y).alias("target")) for x in c for y in c if x != y])
    return b.select("run_id").distinct().select("run_id", F.inline(pairs)).join(b, ["run_id", "source", "target"], "left_anti")


@query("a11_bootstrap", "A11")
def bootstrap(s, d):
    """95 % interval of accuracy over 200 Poisson resamples by hash: counts per resample come from one pass."""
    b = _base(s, d).select("id", (F.col("gold") == F.col("pred")).cast("double").alias("hit"))
    draws = b.select("hit", F.posexplode(F.transform(F.sequence(F.lit(1), F.lit(200)), lambda k: F.pmod(F.xxhash64("id", k), F.lit(1_000_000)) / 1_000_000.0)).alias("k", "u"))
    w = F.when(F.col("u") < 0.367879, 0).when(F.col("u") < 0.735759, 1).when(F.col("u") < 0.919699, 2).when(F.col("u") < 0.981012, 3).when(F.col("u") < 0.996340, 4).otherwise(5)
    g = draws.withColumn("w", w).groupBy("k").agg((F.sum(F.col("hit") * F.col("w")) / F.sum("w")).alias("acc"))
    return g.agg(F.round(F.avg("acc"), 6).alias("mean"), F.round(F.percentile("acc", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("acc", F.lit(0.975)), 6).alias("high"))


@query("a18_rate_panel", "A18 A20", """
with p as (select distinct id, run_id, format_valid, semantic_valid, cognitive_valid, topic_preserved, trivial_transform, fully_validated, semantic_similarity, task from predictions)
select run_id, count(*)::bigint as n, round(coalesce(avg(format_valid::int),0),6) as format_rate, round(coalesce(avg(semantic_valid::int),0),6) as semantic_rate, round(coalesce(avg(cognitive_valid::int),0),6) as cognitive_rate, round(coalesce(avg(trivial_transform::int),0),6) as trivial_rate, round(coalesce(avg(fully_validated::int),0),6) as validated_rate, round(coalesce(avg(semantic_similarity),0),9) as mean_similarity
from p where task='bloom_rewrite' group by 1""")
def rate_panel(s, d):
    flags = {"format_rate": "format_valid", "semantic_rate": "semantic_valid", "cognitive_rate": "cognitive_valid", "trivial_rate": "trivial_transform", "validated_rate": "fully_validated"}
    p = table(s, d, "predictions").filter("task = 'bloom_rewrite'").select("id", "run_id", "topic_preserved", "semantic_similarity", *flags.values()).distinct()
    rates = [F.round(F.coalesce(F.avg(F.col(c).cast("int")), F.lit(0.0)), 6).alias(k) for k, c in flags.items()]
    return p.groupBy("run_id").agg(F.count("*").alias("n"), *rates, F.round(F.coalesce(F.avg("semantic_similarity"), F.lit(0.0)), 9).alias("mean_similarity"))


@query("a19_transition_matrix", "A19 J14", f"""
with b as {_BASE}, l as (select * from {_LEVELS_SQL}), s as (select a.label src, b.label tgt from l a, l b where a.label<>b.label),
g as (select src, gold, count(*) n, avg((gold=pred)::int) acc, avg(coalesce(ok,false)::int) v from b group by all)
select s.src as source, s.tgt as target, coalesce(n,0)::bigint as n, round(acc,6) as accuracy, round(v,6) as validated from s left join g on g.src=s.src and g.gold=s.tgt""")
def transitions(s, d):
    c = [x.lower() for x in LEVELS]
    spine = s.createDataFrame([(a, b) for a in c for b in c if a != b], "source string, target string")
    g = _base(s, d).groupBy(F.col("src").alias("source"), F.col("gold").alias("target")).agg(F.count("*").alias("n"), F.avg((F.col("gold") == F.col("pred")).cast("int")).alias("acc"), F.avg(F.coalesce("ok", F.lit(False)).cast("int")).alias("v"))
    return spine.join(g, ["source", "target"], "left").select("source", "target", F.coalesce("n", F.lit(0)).alias("n"), F.round("acc", 6).alias("accuracy"), F.round("v", 6).alias("validated"))


@query("a21_latency", "A21 A22 A23", """
with p as (select distinct id, run_id, latency_s from predictions where latency_s is not null), l as (select run_id, list_sort(list(latency_s)) v from p group by 1)
select run_id, len(v)::bigint as n, round(list_avg(v),5) as mean, v[round_even(0.5*(len(v)-1),0)::int+1] as p50, v[round_even(0.95*(len(v)-1),0)::int+1] as p95, v[floor(0.99*(len(v)-1))::int+1] as p99 from l""")
def latency(s, d):
    """Nearest-rank percentiles by rank; ranks are put together from counts by latency class, so no run is sorted in one task."""
    p = table(s, d, "predictions").filter("latency_s is not null").select("id", "run_id", "latency_s").distinct().withColumn("c", F.floor(F.col("latency_s") * 20))
    hist = p.groupBy("run_id", "c").agg(F.count("*").alias("m"))
    hist = hist.select("run_id", "c", (F.sum("m").over(W.partitionBy("run_id").orderBy("c")) - F.col("m")).alias("before"))
    r = p.withColumn("k", F.row_number().over(W.partitionBy("run_id", "c").orderBy("latency_s")) - 1).join(hist, ["run_id", "c"]).withColumn("k", F.col("k") + F.col("before"))
    n = p.groupBy("run_id").agg(F.count("*").alias("n"), F.round(F.avg("latency_s"), 5).alias("mean"))
    at = lambda c: F.max(F.when(F.col("k") == c, F.col("latency_s")))
    m = F.col("n") - 1
    return r.join(F.broadcast(n), "run_id").groupBy("run_id", "n", "mean").agg(at(F.bround(0.5 * m)).alias("p50"), at(F.bround(0.95 * m)).alias("p95"), at(F.floor(0.99 * m)).alias("p99"))  # one row per run


@query("a39_annotators", "A39 J4", """
with l as (select doc_id, annotator, max(toxic) t from doc_labels where toxic is not null group by all), p as (select a.annotator a, b.annotator b, a.t x, b.t y from l a join l b on a.doc_id=b.doc_id and a.annotator<b.annotator),
g as (select a, b, count(*) n, avg((x=y)::int) po, avg(x) px, avg(y) py from p group by all)
select a, b, n::bigint as n, round(po,6) as agreement, round(case when px*py+(1-px)*(1-py)=1 then 1.0 else (po-(px*py+(1-px)*(1-py)))/(1-(px*py+(1-px)*(1-py))) end,6) as kappa from g""")
def annotators(s, d):
    lab = table(s, d, "doc_labels").filter("toxic is not null").groupBy("doc_id", "annotator").agg(F.max("toxic").alias("t"))
    a, b = lab.select("doc_id", F.col("annotator").alias("a"), F.col("t").alias("x")), lab.select("doc_id", F.col("annotator").alias("b"), F.col("t").alias("y"))
    g = a.join(b, "doc_id").filter("a < b").groupBy("a", "b").agg(F.count("*").alias("n"), F.avg(F.expr("cast(x = y as int)")).alias("po"), F.avg("x").alias("px"), F.avg("y").alias("py"))
    pe = F.expr("px * py + (1 - px) * (1 - py)")
    return g.select("a", "b", "n", F.round("po", 6).alias("agreement"), F.round(F.when(pe == 1, 1.0).otherwise((F.col("po") - pe) / (1 - pe)), 6).alias("kappa"))


@query("a46_error_taxonomy", "A46 A20 R39", """
with p as (select distinct id, regexp_matches(coalesce(prediction,''),'^ *$') p, empty_output e, meta_response m, trivial_transform t, semantic_valid sv, topic_preserved tp, answer_output a, format_valid f, cognitive_valid c, lower(trim(target_bloom_level)) g, lower(trim(classifier_prediction)) k, fully_validated ok from predictions where task='bloom_rewrite'),
c as (select case when coalesce(e,false) or p then 'empty' when coalesce(m,false) then 'meta' when coalesce(t,false) then 'trivial' when not coalesce(sv,false) or tp=false then 'topic_drift' when coalesce(a,false) then 'answer' when not coalesce(f,false) then 'malformed' when not coalesce(c,false) then 'wrong_demand' when k is not null and g is not null and k<>g then 'wrong_level' when coalesce(ok,false) then 'OK' else 'wrong_level' end category from p)
select category, count(*)::bigint as n from c group by 1""")
def taxonomy(s, d):
    cols = ["empty_output", "meta_response", "trivial_transform", "semantic_valid", "topic_preserved", "answer_output", "format_valid", "cognitive_valid", "fully_validated", "target_bloom_level", "classifier_prediction"]
    p = table(s, d, "predictions").filter("task = 'bloom_rewrite'").select("id", "prediction", *cols).distinct()
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    low = lambda c: F.lower(F.trim(F.col(c)))
    c = (
        F.when(yes("empty_output") | F.coalesce("prediction", F.lit("")).rlike(r"\A *\z"), "empty")
        .when(yes("meta_response"), "meta")
        .when(yes("trivial_transform"), "trivial")
        .when(~yes("semantic_valid") | F.coalesce(~F.col("topic_preserved"), F.lit(False)), "topic_drift")
        .when(yes("answer_output"), "answer")
        .when(~yes("format_valid"), "malformed")
        .when(~yes("cognitive_valid"), "wrong_demand")
        .when(low("classifier_prediction") != low("target_bloom_level"), "wrong_level")
        .when(yes("fully_validated"), "OK")
        .otherwise("wrong_level")
    )
    return p.groupBy(c.alias("category")).agg(F.count("*").alias("n"))


@query("a47_metric_deltas", "A47 R21 R23 R27", """
with p as (select distinct id, run_id, fully_validated, semantic_similarity, latency_s from predictions where run_id in ('run-base-fp16','run-fedprox-q4')),
g as (select run_id, avg(fully_validated::int) a, avg(semantic_similarity) b, avg(latency_s) c from p group by 1), l as (select run_id, m, v from (select run_id, unnest(['validated','similarity','latency']) m, unnest([a,b,c]) v from g))
select x.m as metric, round(x.v,5) as baseline, round(y.v,5) as improved, round(y.v-x.v,4) as delta from l x join l y on x.m=y.m where x.run_id='run-base-fp16' and y.run_id='run-fedprox-q4'""")
def deltas(s, d):
    p = table(s, d, "predictions").filter("run_id in ('run-base-fp16', 'run-fedprox-q4')").select("id", "run_id", "fully_validated", "semantic_similarity", "latency_s").distinct()
    g = p.groupBy("run_id").agg(F.avg(F.col("fully_validated").cast("int")).alias("validated"), F.avg("semantic_similarity").alias("similarity"), F.avg("latency_s").alias("latency"))
    long = g.unpivot("run_id", ["validated", "similarity", "latency"], "metric", "v")
    x, y = long.filter("run_id = 'run-base-fp16'"), long.filter("run_id = 'run-fedprox-q4'").select("metric", F.col("v").alias("w"))
    return x.join(y, "metric").select("metric", F.round("v", 5).alias("baseline"), F.round("w", 5).alias("improved"), F.round(F.col("w") - F.col("v"), 4).alias("delta"))


@query("a15_rouge", "A15 A16 A17")
def rouge(s, d):
    """(id, rouge1, rouge_l, meteor) of summaries against their references; the subsequence needs an Arrow function."""
    from spindrift.operators.sequences import overlap_scores

    p = table(s, d, "predictions").filter("task = 'summarization' and prediction is not null and reference is not null").select("id", "prediction", "reference").distinct()
    return overlap_scores(p)
