"""python -m tessera.cli build-corpus | build-index | search | evaluate | export: the operators from a shell."""

from __future__ import annotations

import argparse
import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import index, metrics, ranking
from tessera.plans import query as plans
from tessera.sources import articles, trec


def _documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def build_corpus(spark: SparkSession, args: argparse.Namespace) -> str:
    raw = articles.read_jsonl(spark, args.docs).withColumn("_n", F.monotonically_increasing_id())
    articles.build_corpus(raw, order="_n", most=args.most).drop("_n").write.mode("overwrite").parquet(args.out)
    return json.dumps(articles.corpus_stats(spark.read.parquet(args.out)).first().asDict())


def build_index(spark: SparkSession, args: argparse.Namespace) -> str:
    docs = _documents(spark, args.docs)
    known = index.cached(docs, args.out)[2]
    index.build_positions(docs, args.out)
    return json.dumps({**index.index_stats(docs).first().asDict(), "was_current": known})


def search(spark: SparkSession, args: argparse.Namespace) -> str:
    docs = _documents(spark, args.docs)
    if args.model == "auto":
        found = plans.search(docs, args.query, fields={c for c in docs.columns if c != "text"}, k=args.k)
    else:
        found = ranking.dispatch(docs, args.model, re.findall(r"[一-鿿]+|[a-z0-9]+", args.query.lower()), args.k)
    return "\n".join(json.dumps(r.asDict()) for r in found.orderBy("rank").collect())  # k rows


def evaluate(spark: SparkSession, args: argparse.Namespace) -> str:
    return json.dumps(metrics.overall(trec.read_run(spark, args.run), trec.read_qrels(spark, args.qrels), args.k).first().asDict())


def export(spark: SparkSession, args: argparse.Namespace) -> str:
    trec.export(_documents(spark, args.docs), args.out, args.form)
    return json.dumps({"written": args.out})


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> str:
    p = argparse.ArgumentParser(prog="tessera", description=__doc__)
    sub = p.add_subparsers(required=True)
    for fn, names in ((build_corpus, ("docs", "out")), (build_index, ("docs", "out")), (search, ("docs", "query")), (evaluate, ("run", "qrels")), (export, ("docs", "out"))):
        one = sub.add_parser(fn.__name__.replace("_", "-"))
        one.set_defaults(fn=fn)
        for n in names:
            one.add_argument(n)
        one.add_argument("--k", type=int, default=10)
        one.add_argument("--model", default="auto", choices=["auto", *sorted(ranking.MODELS)])
        one.add_argument("--most", type=int)
        one.add_argument("--form", default="json", choices=["json", "csv"])
    args = p.parse_args(argv)
    out = args.fn(spark or SparkSession.builder.appName("tessera").getOrCreate(), args)
    print(out)
    return out


if __name__ == "__main__":
    main()
