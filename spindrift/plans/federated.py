"""Weighted aggregation of client updates and round accounting (A41 to A45, M7, N15 to N20, R2 to R14), on events and embeddings as stand-ins."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.operators import federated as O
from spindrift.plans.registry import query
from spindrift.runtime import table


@query("a41_weighted_average", "A41 R8", """
with x as (select label%5 client, vec_id, unnest(embedding)::double v, unnest(range(len(embedding))) pos from embeddings), n as (select label%5 client, count(*) n from embeddings group by 1), m as (select client, pos, avg(v) a from x group by all)
select pos::bigint as pos, round(sum(n*a)/sum(n),5) as value from m join n using(client) group by 1""")
def weighted_average(s, d):
    e = table(s, d, "embeddings").select((F.col("label") % 5).alias("client"), "embedding")
    return O.weighted_average(e)


@query("n15_clipped_deltas", "N15 R11 N16", """
with x as (select label client, unnest(embedding)::double v, unnest(range(len(embedding))) pos from embeddings), m as (select client, pos, avg(v) a from x group by all), g as (select pos, avg(a) g from m group by 1), t as (select client, sqrt(sum(pow(a-g,2))) n from m join g using(pos) group by 1)
select client, round(n,5) as norm, round(least(1.0,0.3/greatest(n,1e-12)),5) as scale from t""")
def clipped_deltas(s, d):
    return O.delta_norms(table(s, d, "embeddings").select(F.col("label").alias("client"), "embedding"), 0.3)


@query("a43_round_totals", "A43 R12", """
with e as (select date_trunc('day',ts)::date round, user_id%7 client, value from events)
select coalesce(strftime(round,'%Y-%m-%d'),'all') as round, coalesce(client::varchar,'all') as client, count(*)::bigint as steps, round(sum(value),2) as bytes from e group by rollup(round, client)""")
def round_totals(s, d):
    e = table(s, d, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("round"), (F.col("user_id") % 7).cast("string").alias("client"), "value")
    return e.rollup("round", "client").agg(F.count("*").alias("steps"), F.round(F.sum("value"), 2).alias("bytes")).select(F.coalesce("round", F.lit("all")).alias("round"), F.coalesce("client", F.lit("all")).alias("client"), "steps", "bytes")


@query("w11_best_round", "W11", """
with r as (select run_id, date_trunc('month',evaluated_at)::date round, round(avg(target_match::int),6) acc, round(avg(semantic_similarity),4) sim from (select distinct id, run_id, evaluated_at, target_match, semantic_similarity from predictions where target_match is not null) group by all)
select run_id, strftime(round,'%Y-%m') as round, acc as accuracy, sim as similarity from r qualify row_number() over(partition by run_id order by acc desc, sim desc, round)=1""")
def best_round(s, d):
    p = table(s, d, "predictions").filter("target_match is not null").select("id", "run_id", "evaluated_at", "target_match", "semantic_similarity").distinct()
    r = p.groupBy("run_id", F.date_format("evaluated_at", "yyyy-MM").alias("round")).agg(F.round(F.avg(F.col("target_match").cast("int")), 6).alias("accuracy"), F.round(F.avg("semantic_similarity"), 4).alias("similarity"))
    # The lexicographic best as one aggregate; nothing is sorted.
    b = r.groupBy("run_id").agg(F.min(F.struct((-F.col("accuracy")).alias("a"), (-F.col("similarity")).alias("b"), "round")).alias("x"))
    return b.select("run_id", F.col("x.round").alias("round"), (-F.col("x.a")).alias("accuracy"), (-F.col("x.b")).alias("similarity"))


@query("n18_privacy_budget", "N17 N18 N19", """
with c as (select user_id%7 client, count(*) n from events group by 1), q as (select client, n, least(1.0,64.0/n) q, 100.0 t from c),
a as (select client, n, q, t, unnest(range(2,65)) al from q)
select client, n::bigint as n, ceil(ceil(n/64.0)*3)::bigint as steps, round(min(t*q*q*al/(2*1.1*1.1)+ln(1e5)/(al-1)),6) as epsilon, round(min(q)*sqrt(2*100*ln(1e5))/1.1,6) as simple from a group by client, n""")
def privacy_budget(s, d):
    c = table(s, d, "events").groupBy((F.col("user_id") % 7).alias("client")).agg(F.count("*").alias("n"))
    return O.epsilon(c, batch=64, steps=100, sigma=1.1, delta=1e-5)


@query("r09_masks_cancel", "A42 R9 R10 N27", """
with m as (select label client, pos, sum(v) v from (select label, unnest(embedding)::double v, unnest(range(len(embedding))) pos from embeddings) group by all) select pos::bigint as pos, round(sum(v),4) as total, true as cancels from m group by 1""")
def masks_cancel(s, d):
    return O.masked_totals(table(s, d, "embeddings").select(F.col("label").alias("client"), "embedding"))


@query("r05_upload_bytes", "R5", """
select label%5 as client, sum(octet_length(encode(array_to_string(embedding::decimal(9,3)[],','))))::bigint as bytes, count(*)::bigint as updates from embeddings group by 1""")
def upload_bytes(s, d):
    p = F.array_join(F.transform("embedding", lambda x: x.cast("decimal(9,3)").cast("string")), ",")
    t = table(s, d, "embeddings").select((F.col("label") % 5).alias("client"), F.base64(p.cast("binary")).alias("payload"))
    return t.groupBy("client").agg(F.sum(F.octet_length(F.unbase64("payload"))).alias("bytes"), F.count("*").alias("updates"))


@query("m01_federated_guard", "M1")
def federated_guard(s, d):
    """(round, accuracy, loss) of a logistic guard for toxic documents, trained over clients with clipping and noise."""
    lab = table(s, d, "doc_labels").filter("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y"))
    docs = table(s, d, "documents").filter("text is not null").select("doc_id", "text").join(F.broadcast(lab), "doc_id")  # a partial sample of labels
    return O.federated_logistic(docs, rounds=3)


@query("m03_linear_baseline", "M3")
def linear_baseline(s, d):
    """(n, accuracy) of TF-IDF and a linear model on half of the labelled documents, tested on the other half."""
    return O.linear_baseline(table(s, d, "documents").filter("text is not null and source is not null").select("doc_id", "text", "content_type"))
