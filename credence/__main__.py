"""Command line: ``spark-submit --py-files ... -m credence <job> ...``."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from . import schemas
from .functions import text
from .operators import evaluate, profile, sample
from .plans import build, collect, predict, train
from .session import build_session
from .sources import articles, dimensions


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="credence", description=__doc__)
    jobs = parser.add_subparsers(dest="job", required=True)

    job = jobs.add_parser("collect", help="stored pages (site, url, html) to articles")
    job.add_argument("pages")
    job.add_argument("out")
    job.add_argument("--listed", metavar="SITE_LIST", help="take the sites of this list, least credible")

    job = jobs.add_parser("build", help="raw articles to the processed table")
    job.add_argument("known")
    job.add_argument("listed")
    job.add_argument("out")
    job.add_argument("--tables", action="store_true", help="inputs are tables of collect, not article folders")
    job.add_argument("--mode", choices=("literal", "listed"), default="literal")

    job = jobs.add_parser("frequency", help="token counts of a processed table")
    job.add_argument("processed")
    job.add_argument("out")
    job.add_argument("--polarity", type=int, choices=(0, 1), default=0)

    job = jobs.add_parser("train", help="sample, train, evaluate, save")
    job.add_argument("processed")
    job.add_argument("model")
    job.add_argument("--label", choices=("sentiment", "polarity"), default="sentiment")
    job.add_argument("--seed", type=int, default=7)
    job.add_argument("--corpora", choices=("known", "combined"), default="combined", help="what to train on")
    job.add_argument("--spaces", choices=("raw", "stripped"), default="raw", help="strip line breaks and tabs first")
    job.add_argument("--token-limit", type=int, help="tokens the model reads of a text, two special ones included")
    job.add_argument("--sample", type=int, default=10_000, help="articles drawn")
    job.add_argument("--slice", action="append", default=[], metavar="NAME=START:END",
                     help="positions of a slice of the sample, the end not included; replaces the usual ones")

    job = jobs.add_parser("predict", help="label the sentences of a text file")
    job.add_argument("model")
    job.add_argument("sentences")
    job.add_argument("out")
    job.add_argument("--label", choices=("sentiment", "polarity"), default="sentiment")

    args = parser.parse_args(argv)
    spark = build_session(f"credence-{args.job}")
    labels = {"sentiment": tuple(range(11)), "polarity": (0, 1)}

    if args.job == "collect":
        pages = spark.read.schema(schemas.PAGES).parquet(args.pages)
        if args.listed:
            sites = dimensions.read_site_list(spark, args.listed).distinct()
            found = collect.listed_articles(pages.join(sites, "site", "left_semi"))
        else:
            found = collect.known_articles(
                pages, dimensions.excluded_hosts(spark), dimensions.site_scores(spark)
            )
        collect.store_articles(found, args.out)
    elif args.job == "build":
        if args.tables:
            stored = [articles.read_articles(spark, path) for path in (args.known, args.listed)]
            raw = build.raw_table(stored[0].unionByName(stored[1]))
        else:
            raw = build.raw_folders(spark, {"known": args.known, "listed": args.listed})
        build.build_corpora(raw, args.out, args.mode).show()
    elif args.job == "frequency":
        # Copies share their polarity, so the other side need not be read at all.
        side = spark.read.schema(schemas.PROCESSED).parquet(args.processed).filter(F.col("polarity") == args.polarity)
        chosen = build.combined(side)
        profile.by_count(profile.token_frequency(chosen)).write.mode("overwrite").parquet(args.out)
    elif args.job == "train":
        processed = spark.read.schema(schemas.PROCESSED).parquet(args.processed)
        rows = build.combined(processed) if args.corpora == "combined" else build.known(processed)
        if args.spaces == "stripped":
            rows = rows.withColumn("text", text.strip_control("text"))
        slices = {name: tuple(map(int, span.split(":"))) for name, _, span in (s.partition("=") for s in args.slice)}
        trained = train.train_and_evaluate(
            rows.withColumnRenamed("text", "sentence"), label_column=args.label, label_list=labels[args.label],
            n=args.sample, slices=slices or sample.DEFAULT_SLICES, seed=args.seed,
            token_limit=args.token_limit and args.token_limit - 2,
        )
        trained.model.write().overwrite().save(args.model)
        trained.path.write.mode("overwrite").parquet(args.model.rstrip("/") + "-penalties")
        trained.path.show()
        evaluate.split_measures(trained.judged, binary=args.label == "polarity").show()
    else:
        sentences = spark.read.text(args.sentences).withColumnRenamed("value", "sentence")
        predict.predict_to_table(args.model, sentences, args.out, labels[args.label])


if __name__ == "__main__":
    main()
