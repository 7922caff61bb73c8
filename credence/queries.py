"""The registered queries: every operator over the whole driver tables.

Stand-ins: ``documents`` are articles (``source`` is the site; src15 to src19 are the
listed corpus), ``pages`` are stored pages, ``labels.quality`` is the binary truth,
``embeddings`` are sentence vectors with ten labels, and a user turn with the next
assistant turn of ``conversations`` is a text pair.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import keys, text, vectors
from .operators import encode, evaluate, ingest, label, merge, model, profile, sample, subword, tally
from .plans import build, collect, predict, train
from .session import shared_folder, staging
from .sources import articles, dimensions, scans
from .streaming import incremental

# Scores of the stand-in sites; src6 and src13 have none.
SOURCE_SCORES = {f"src{i}": 10 - (3 * i) % 10 for i in range(20) if i not in (6, 13)}
LISTED_SOURCES = [f"src{i}" for i in range(15, 20)]
# Lines and phrases that recur in the documents, in place of publishers' boilerplate.
RECURRING = ("And ornd.", "of the", "que la", "(And)")
SEED = 7
MAX_LEN = 32
VOCABULARY_SIZE = 2000
BUCKETS = 16
LABELS = list(range(11))
SAMPLE = 1000
SLICES = {"train": (0, 900), "dev": (901, 950), "test": (951, 999)}
# The slices of a training sample are shares of the rows drawn, so that smaller tables fill them too.
TRAIN_SAMPLE = 10_000
VECTOR_SIZE, VECTOR_LABELS = 64, 10
WEIGHTS = [[((31 * k + 17 * i) % 23 - 11) / 50 for i in range(VECTOR_SIZE)] for k in range(VECTOR_LABELS)]
BIAS = [(k % 5 - 2) / 10 for k in range(VECTOR_LABELS)]


# --- stand-in inputs -------------------------------------------------------------

def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").withColumnRenamed("source", "site")


def _scores(spark: SparkSession) -> DataFrame:
    return dimensions.score_table(spark, SOURCE_SCORES)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label.attach_polarity(label.attach_score(_documents(spark, sf_dir), _scores(spark)))


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _documents(spark, sf_dir).filter(~F.col("site").isin(LISTED_SOURCES))
    return label.attach_polarity(label.attach_score(known, _scores(spark))).withColumn("corpus", F.lit("known"))


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _documents(spark, sf_dir).filter(F.col("site").isin(LISTED_SOURCES))
    return label.attach_polarity(label.attach_constant_score(listed)).withColumn("corpus", F.lit("listed"))


def _corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _known(spark, sf_dir).unionByName(_listed(spark, sf_dir))


def _keyed(df: DataFrame) -> DataFrame:
    return label.attach_content_key(df)


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.with_host(_table(spark, sf_dir, "pages"))


def _mobile_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for the excluded hosts: mobile editions."""
    return _pages(spark, sf_dir).select("host").filter(F.col("host").startswith("m.")).distinct()


def _host_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stand-in for site scores by host; hosts whose length divides by 7 have none."""
    hosts = _pages(spark, sf_dir).select(F.col("host").alias("site")).distinct()
    length = F.length("site")
    return hosts.filter(length % 7 != 0).withColumn("sentiment", (length % 10 + 1).cast("int"))


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored documents as a folder scan would give them: ``folder, name, value``.

    German texts lose their encoding and Spanish ones the score in their name, so both
    kinds of failure occur.
    """
    scored = _keyed(_scored(spark, sf_dir))
    name = keys.article_name("sha1", "sentiment")
    broken = F.concat(F.unhex(F.lit("FFFE")), F.col("text").cast("binary")).cast("string")
    return scored.select(
        "doc_id",
        F.when(F.col("polarity") == 1, "pos").otherwise("neg").alias("folder"),
        F.when(F.col("lang") == "es", F.col("sha1")).otherwise(name).alias("name"),
        F.when(F.col("lang") == "de", broken).otherwise(F.col("text")).alias("value"),
    )


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.token_frequency(_documents(spark, sf_dir))


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode.vocabulary(_counts(spark, sf_dir), VOCABULARY_SIZE)


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn right after it, where there is one."""
    turns = _table(spark, sf_dir, "conversations")
    asked = turns.filter(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("text_a"))
    replied = turns.filter(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("text_b")
    )
    return asked.join(replied, ["conv_id", "turn"], "left").withColumn(
        "pair_id", F.concat_ws("-", "conv_id", "turn")
    )


def _judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth: ``labels.quality``. Prediction: a text of at least 1,000 characters is good."""
    truth = _table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    sizes = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return sizes.join(truth, "doc_id").select(
        "doc_id", "label", (F.col("n_chars") >= 1000).cast("int").alias("pred")
    )


def _vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", vectors.linear_logits("embedding", WEIGHTS, BIAS).alias("logits")
    )
    return vectors.with_log_softmax(scored).select(
        "vec_id", "label", "log_probs", vectors.argmax("log_probs").alias("pred")
    )


def _flat(features: DataFrame, *others: str) -> DataFrame:
    """Id arrays as comma-joined strings, so that any engine compares them alike."""
    return features.select(
        *others,
        *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
          for c in ("input_ids", "input_mask", "segment_ids")],
    )


# --- sources and sinks -----------------------------------------------------------

def kept_articles(spark, d):
    """Flagship: score, keep long enough articles, one per copy, count by site and polarity."""
    kept = _keyed(label.attach_score(_documents(spark, d), _scores(spark)).filter(text.has_min_words("text")))
    unique = merge.dedupe_exact(kept.select("doc_id", "site", "sha1", "sentiment"), ["doc_id"])
    return label.attach_polarity(unique).groupBy("site", "polarity").agg(F.count("*").alias("articles"))


def site_list(spark, d):
    """The hosts written as a site list, and the list read."""
    path = shared_folder(spark)
    dimensions.write_site_list(_pages(spark, d).select(F.concat("host", F.lit(" \t")).alias("site")), path)
    return dimensions.read_site_list(spark, path)


def site_union(spark, d):
    sites = _documents(spark, d).select("site").distinct()
    listed = F.col("site").isin(LISTED_SOURCES)
    return dimensions.concat_site_lists(
        sites.filter(~listed).withColumn("grp", F.lit("known")),
        sites.filter(listed).withColumn("grp", F.lit("listed")),
    )


def _folder(spark: SparkSession, d: str) -> str:
    path = shared_folder(spark)
    scans.write_files(_files(spark, d), path)
    return path


def text_scan(spark, d):
    """The documents written as one file each, and the folder scanned."""
    files = scans.article_files(scans.scan_files(spark, _folder(spark, d)))
    return files.select("name", "sha1", "sentiment", "polarity", keys.content_key("text").alias("text_sha1"))


def labelled_scan(spark, d):
    return scans.read_labelled(spark, _folder(spark, d)).select(
        "name", "sentiment", "polarity", keys.content_key("sentence").alias("sentence_sha1")
    )


def page_text(spark, d):
    return ingest.extract_text(_table(spark, d, "pages").select("page_id", "html"))


def page_article(spark, d):
    return ingest.extract_article(_table(spark, d, "pages").select("page_id", "html"))


def collect_known(spark, d):
    pages = _table(spark, d, "pages").select(keys.host("url").alias("site"), "url", "html")
    found = collect.known_articles(pages, _mobile_hosts(spark, d), _host_scores(spark, d))
    return found.select("sha1", "site", "url", "sentiment", "polarity", "corpus", F.length("text").alias("chars"))


def collect_listed(spark, d):
    pages = _table(spark, d, "pages").select(keys.host("url").alias("site"), "url", "html")
    return collect.listed_articles(pages).select("sha1", "url", "sentiment", "polarity", "corpus")


def collect_stored(spark, d):
    """Listed articles stored one per copy, and read back. Some pages were fetched twice under
    one URL, some have none."""
    pages = _table(spark, d, "pages").select(keys.host("url").alias("site"), "page_id", "url", "html")
    again = pages.filter(F.col("page_id") % 5 == 0).withColumn("url", F.when(F.col("page_id") % 2 == 0, F.col("url")))
    moved = pages.filter(F.col("page_id") % 7 == 0).withColumn("url", F.lit("https://one.example/for/many"))
    crawled = pages.unionByName(again).unionByName(moved).select("site", "url", "html")
    path = shared_folder(spark)
    collect.store_articles(collect.listed_articles(crawled), path)
    return articles.read_articles(spark, path).select("sha1", "site", "url", "sentiment", "polarity", "corpus")


def article_sink(spark, d):
    """Written by corpus and polarity, then both sides read back."""
    path = shared_folder(spark)
    rows = _keyed(_corpora(spark, d)).select("doc_id", "sha1", "text", "sentiment", "polarity", "corpus")
    articles.write_articles(rows, path)
    stored = articles.read_articles(spark, path, rows.schema)
    return stored.select(
        "doc_id", "corpus", "sentiment", "polarity", (keys.content_key("text") == F.col("sha1")).alias("intact")
    )


def clean_corpus_job(spark, d):
    """The job that the command line runs; its counts beside the characters it stored."""
    path = shared_folder(spark)
    raw = _keyed(_corpora(spark, d)).select("doc_id", "sha1", "text", "sentiment", "polarity", "corpus")
    counts = build.build_corpora(raw, path)
    stored = articles.read_articles(spark, path, raw.schema)
    chars = stored.groupBy("corpus", "polarity").agg(F.sum(F.length("text")).alias("chars"))
    return counts.join(chars, ["corpus", "polarity"])


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return _pages(spark, d).select(
        "page_id", "url", "host", keys.content_key("html").alias("sha1"),
        F.lit("known").alias("corpus"), F.lit(1).alias("polarity"),
    )


def incremental_append(spark, d):
    """Blog pages are stored by a first run; the second run offers all pages."""
    path = shared_folder(spark)
    pages = _candidates(spark, d)
    incremental.append_unseen(pages.filter(F.col("host").startswith("blog.")), path)
    incremental.append_unseen(pages, path)
    return spark.read.parquet(path).select("page_id", "url")


def incremental_stream(spark, d):
    """The same as a stream with state: the files of the blog pages, then those of all pages and,
    again, of the blog pages. The number of each batch that stored a page comes with it."""
    path = shared_folder(spark)
    pages = _candidates(spark, d)
    blogs = pages.filter(F.col("host").startswith("blog."))

    def arrive(files: DataFrame) -> None:
        files.write.mode("append").parquet(f"{path}/in")
        query = incremental.stateful_stream(
            spark.readStream.schema(pages.schema).parquet(f"{path}/in"), lambda rows: rows, f"{path}/out", f"{path}/checkpoint")
        query.awaitTermination()

    arrive(blogs)
    arrive(pages.unionAll(blogs))
    stored = spark.read.schema(pages.schema).option("recursiveFileLookup", "true").parquet(f"{path}/out")
    batch = F.regexp_extract(F.col("_metadata.file_path"), "/batch=([0-9]+)/", 1).cast("int")
    return stored.select("page_id", "url", batch.alias("batch"))


# --- projections, filters, scalar functions, joins ---------------------------------

def tokenize(spark, d):
    return _documents(spark, d).select("doc_id", F.array_join(text.tokens("text"), " ").alias("tokens"))


def host_extract(spark, d):
    return _pages(spark, d).select("page_id", "host")


def host_exclude(spark, d):
    return ingest.drop_excluded(_pages(spark, d).select("page_id", "host"), _mobile_hosts(spark, d))


def seen_url_anti(spark, d):
    pages = _pages(spark, d).select("page_id", "url", "host")
    return ingest.drop_seen(pages, pages.filter(F.col("host").startswith("blog."))).select("page_id", "url")


def strip_control(spark, d):
    return _documents(spark, d).select("doc_id", text.strip_control("text").alias("text"))


def strip_literal_token(spark, d):
    return _documents(spark, d).select("doc_id", text.clean("text").alias("text"))


def strip_listed_tokens(spark, d):
    return _documents(spark, d).select("doc_id", text.clean("text", "listed", RECURRING).alias("text"))


def min_words(spark, d):
    pieces = text.space_pieces("text")
    return _documents(spark, d).select("doc_id", pieces.alias("pieces")).filter(F.col("pieces") >= 50)


def min_chars(spark, d):
    return _documents(spark, d).filter(text.has_min_chars("text")).select("doc_id")


def site_scored(spark, d):
    return _scored(spark, d).select("doc_id", "site", "sentiment")


def unscored_report(spark, d):
    return label.unscored_sites(_documents(spark, d), _scores(spark))


def polarity(spark, d):
    return _scored(spark, d).select("doc_id", "polarity")


def constant_score(spark, d):
    return _listed(spark, d).select("doc_id", "sentiment", "polarity")


def content_key(spark, d):
    return _keyed(_documents(spark, d)).select("doc_id", "sha1")


def name_roundtrip(spark, d):
    named = merge.with_article_name(_keyed(_scored(spark, d)))
    return named.select("doc_id", "name", keys.score_of_name("name").alias("sentiment"))


def hash_split(spark, d):
    return _keyed(_documents(spark, d)).select("doc_id", keys.hash_split("sha1").alias("split"))


def example_projection(spark, d):
    rows = _corpora(spark, d).select("doc_id", F.col("text").alias("sentence"), "sentiment", "polarity")
    return label.as_examples(rows, label="polarity", keep=("doc_id",))


def label_index(spark, d):
    rows = label.attach_score(_documents(spark, d), _scores(spark), keep_unscored=True)
    kinds = [10, 9, 8, 7, 6, 5, 4, 3, 1]
    return rows.select("doc_id", label.label_index("sentiment", kinds).alias("label_id"))


def label_names(spark, d):
    return _judged(spark, d).select("doc_id", label.label_name("pred").alias("label"))


# --- aggregations ------------------------------------------------------------------

def _page_reasons(spark: SparkSession, d: str) -> DataFrame:
    pages = _pages(spark, d).select("host", F.col("host").alias("site"), "html")
    return tally.reason_counts(
        ingest.extract_article(pages), _mobile_hosts(spark, d), _host_scores(spark, d), words=200
    )


def drop_reasons(spark, d):
    return _page_reasons(spark, d)


def _document_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Documents by site; the site stands for its host too, and src3 is excluded."""
    found = _documents(spark, d).select("site", F.col("site").alias("host"), "text")
    return tally.reason_counts(found, dimensions.host_table(spark, ["src3"]), _scores(spark))


def site_counts(spark, d):
    return tally.site_counts(_document_reasons(spark, d))


def site_rollup(spark, d):
    return tally.site_rollup(_document_reasons(spark, d))


def polarity_counts(spark, d):
    return tally.polarity_counts(_corpora(spark, d))


def corpus_counts(spark, d):
    return tally.corpus_counts(_corpora(spark, d))


def load_counts(spark, d):
    return tally.load_counts(scans.with_load_status(_files(spark, d)))


def token_frequency(spark, d):
    return _counts(spark, d)


def token_frequency_neg(spark, d):
    return profile.by_count(profile.token_frequency(_corpora(spark, d).filter(F.col("polarity") == 0)))


# --- order, samples, set operations --------------------------------------------------

def shuffled(spark, d):
    rows = _documents(spark, d).select("doc_id", "lang")
    return sample.shuffle(rows, "doc_id", SEED).withColumn("order_key", keys.shuffle_key("doc_id", SEED))


def sample_n(spark, d):
    return sample.sample_n(_documents(spark, d).select("doc_id", "site", "text"), 150, "doc_id", SEED).select(
        "doc_id", "site", "text"
    )


def split_slices(spark, d):
    drawn = sample.sample_n(_documents(spark, d).select("doc_id", "site"), SAMPLE, "doc_id", SEED)
    return sample.slice_split(drawn, "doc_id", SLICES).select("doc_id", "position", "split")


def preview(spark, d):
    return sample.preview(_documents(spark, d).select("doc_id", "site", "lang"), "doc_id")


def exact_dedupe(spark, d):
    rows = _keyed(_scored(spark, d)).select("doc_id", "sha1", "sentiment")
    return merge.dedupe_exact(rows, ["doc_id"])


def dedupe_texts(spark, d):
    """The same with the whole texts carried along."""
    rows = _keyed(_scored(spark, d)).select("doc_id", "sha1", "sentiment", "text")
    return merge.dedupe_exact(rows, ["doc_id"], unique_ids=True)


def cleaned_dedupe(spark, d):
    """The option of keying on the cleaned text."""
    rows = _scored(spark, d).select("doc_id", keys.content_key(text.clean("text")).alias("sha1"), "sentiment")
    return merge.dedupe_exact(rows, ["doc_id"])


def combined_corpus(spark, d):
    narrow = ("doc_id", "corpus", "sha1", "sentiment", "polarity")
    known, listed = _keyed(_known(spark, d)).select(*narrow), _keyed(_listed(spark, d)).select(*narrow)
    return merge.combine_corpora(known, listed, ["corpus", "doc_id"])


def labelled_concat(spark, d):
    scored = _scored(spark, d)
    sentences = scored.select("doc_id", "sentiment", "polarity")
    positive = sentences.filter(F.col("polarity") == 1).drop("polarity")
    negative = sentences.filter(F.col("polarity") == 0).drop("polarity")
    return merge.concat_labelled(positive, negative)


# --- features ------------------------------------------------------------------------

def vocabulary(spark, d):
    return _vocabulary(spark, d)


def _encoded(spark: SparkSession, d: str) -> DataFrame:
    scored = label.attach_score(_documents(spark, d), _scores(spark), keep_unscored=True)
    label_id = label.label_index("sentiment", LABELS).alias("label_id")
    examples = scored.select("doc_id", F.col("text").alias("text_a"), label_id)
    return encode.encode_single(examples, _vocabulary(spark, d), MAX_LEN, id="doc_id", keep=("label_id",))


def encode_single(spark, d):
    return _flat(_encoded(spark, d), "doc_id", "label_id")


def encode_clustered(spark, d):
    """Cleaned articles stored in parts by their id, and encoded without another shuffle of them."""
    cleaned = build.clean_articles(_corpora(spark, d)).select("doc_id", F.col("text").alias("text_a"))
    stored = articles.clustered_for_session(cleaned, "doc_id", BUCKETS)
    return _flat(encode.encode_single(stored, staging(_vocabulary(spark, d)), MAX_LEN, id="doc_id"), "doc_id")


def encode_quality(spark, d):
    return encode.quality(_encoded(spark, d), MAX_LEN)


def encode_pair(spark, d):
    counts = profile.token_frequency(_table(spark, d, "conversations"))
    vocab = encode.vocabulary(counts, VOCABULARY_SIZE)
    return _flat(encode.encode_pair(_pairs(spark, d), vocab, MAX_LEN, id="pair_id"), "pair_id")


def subword_vocabulary(spark, d):
    return subword.subword_vocabulary(_counts(spark, d), VOCABULARY_SIZE)


def encode_subword(spark, d):
    vocab = staging(subword_vocabulary(spark, d))
    examples = _documents(spark, d).select("doc_id", F.col("text").alias("text_a"))
    return _flat(subword.encode_subword(examples, vocab, MAX_LEN, id="doc_id"), "doc_id")


def basic_tokens(spark, d):
    return _documents(spark, d).select("doc_id", F.array_join(text.basic_tokens("text"), " ").alias("tokens"))


def encode_basic(spark, d):
    """Word pieces of basic tokens: punctuation apart, accents stripped."""
    counts = profile.token_frequency(_documents(spark, d), words=text.basic_tokens)
    vocab = staging(subword.subword_vocabulary(counts, VOCABULARY_SIZE))
    examples = _documents(spark, d).select("doc_id", F.col("text").alias("text_a"))
    encoded = subword.encode_subword(examples, vocab, MAX_LEN, id="doc_id", words=text.first_basic_tokens)
    return _flat(encoded, "doc_id")


# --- model and evaluation --------------------------------------------------------------

def linear_head(spark, d):
    scored = _vector_scores(spark, d)
    return scored.select("vec_id", "pred", F.posexplode("log_probs").alias("label_id", "log_prob")).withColumn(
        "log_prob", F.round("log_prob", 6)
    )


def one_hot(spark, d):
    hot = vectors.one_hot("label", VECTOR_LABELS)
    return _table(spark, d, "embeddings").select("vec_id", F.posexplode(hot).alias("label_id", "hot"))


def cross_entropy(spark, d):
    scored = _vector_scores(spark, d)
    loss = vectors.cross_entropy("log_probs", "label")
    return scored.select("vec_id", F.round(loss, 6).alias("loss"))


def mean_loss(spark, d):
    scored = _vector_scores(spark, d).withColumnRenamed("label", "label_id")
    return model.mean_loss(scored).select(F.round("loss", 6).alias("loss"))


def accuracy(spark, d):
    return evaluate.accuracy(_judged(spark, d)).select(F.round("accuracy", 9).alias("accuracy"))


def binary_counts(spark, d):
    return evaluate.binary_counts(_judged(spark, d))


def _metric(spark: SparkSession, d: str, *names: str) -> DataFrame:
    rounded: list[Column] = [F.round(n, 9).alias(n) for n in names]
    return evaluate.binary_metrics(_judged(spark, d)).select(*rounded)


def prf1(spark, d):
    return _metric(spark, d, "precision", "recall", "f1")


def hard_auc(spark, d):
    return _metric(spark, d, "auc")


def score_auc(spark, d):
    """The length itself as the score of a text."""
    return evaluate.score_auc(_length_scores(spark, d), "score").select(F.round("auc", 9).alias("auc"))


def _length_scores(spark: SparkSession, d: str) -> DataFrame:
    truth = _table(spark, d, "labels").select("doc_id", F.col("quality").alias("label"))
    sizes = _table(spark, d, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return sizes.join(truth, "doc_id")


def threshold_curve(spark, d):
    """Counts, precision, recall and F1 at every length that a text must have to be called good."""
    curve = evaluate.threshold_curve(_length_scores(spark, d), "score")
    return curve.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "fpr")])


def best_threshold(spark, d):
    best = evaluate.best_threshold(_length_scores(spark, d), "score")
    return best.select("threshold", "tp", "fp", "fn", "tn", F.round("f1", 9).alias("f1"))


def confusion(spark, d):
    return evaluate.confusion(_vector_scores(spark, d))


def variant_counts(spark, d):
    return model.variant_counts(_corpora(spark, d))


def train_softmax(spark, d):
    """The softmax layer fitted on sentence vectors: at the optimum the summed probability of
    each label is the number of rows that have it."""
    labels = list(range(VECTOR_LABELS))
    rows = model.with_label_id(model.with_vector(_table(spark, d, "embeddings"), "embedding"), labels)
    fitted = model.vector_pipeline(reg=0.01).fit(rows)
    return _sums(model.label_sums(model.predict(fitted, rows, labels), labels))


def _sums(sums: DataFrame, *by: str) -> DataFrame:
    return sums.filter("rows > 0").select(*by, "label", "rows", F.round("expected", 1).alias("expected"))


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).select("doc_id", F.col("text").alias("sentence"), "sentiment", "polarity")


# Where this session saved the classifier it trained on a table, with the sentences' labels 0 and 1.
_saved: dict[tuple[str, str], str] = {}


def _classifier(spark: SparkSession, d: str) -> train.Trained:
    trained = train.train_and_evaluate(_sentences(spark, d), "doc_id", "polarity", (0, 1), TRAIN_SAMPLE, seed=SEED)
    path = shared_folder(spark)
    trained.model.write().save(f"{path}/model")
    _saved[spark.sparkContext.applicationId, d] = path
    return trained


def train_evaluate(spark, d):
    """Text classifier on the sliced sample: its measures on every slice, and beside the label
    counts what it expects them to be."""
    judged = staging(_classifier(spark, d).judged)
    measures = evaluate.split_measures(judged, binary=True)
    sums = model.label_sums(judged, (0, 1), "split").filter("label = 1")
    return measures.join(sums.withColumnRenamed("rows", "positives"), "split")


def penalty_path(spark, d):
    """The penalties tried for the labels 0 and 1, judged on the dev slice, and the one chosen."""
    return _classifier(spark, d).path


def train_scores(spark, d):
    """Classifier of the labels 0 to 10: over the training rows the summed probability of a label
    is its count."""
    judged = train.train_and_evaluate(_sentences(spark, d), "doc_id", "sentiment", LABELS, TRAIN_SAMPLE, seed=SEED).judged
    sums = _sums(model.label_sums(judged, LABELS, "split"), "split")
    return sums.withColumn("expected", F.when(F.col("split") == "train", F.col("expected")))


def predict_batch(spark, d):
    """The classifier that this session saved for the table, or a new one, loaded to label every document."""
    if (spark.sparkContext.applicationId, d) not in _saved:
        _classifier(spark, d)
    path = _saved[spark.sparkContext.applicationId, d]
    out = shared_folder(spark)
    sentences = _documents(spark, d).select("doc_id", F.col("text").alias("sentence"))
    predict.predict_to_table(f"{path}/model", sentences, out, (0, 1), keep=("doc_id",))
    found = predict.read_predictions(spark, out, sentences.select("doc_id").schema)
    return found.select("doc_id", F.sha1("sentence").alias("sentence_sha1"), "label", "log_probs")


def variant_runs(spark, d):
    """All variants, trained on the same sample: rows, the penalty taken, accuracy and loss on the
    dev slice, and how far summed probabilities are from label counts at most."""
    rows = _corpora(spark, d).select("doc_id", F.col("text").alias("sentence"), "sentiment", "polarity", "corpus")
    runs = train.run_variants(rows, "doc_id", TRAIN_SAMPLE, seed=SEED)

    def measured(variant: dict, trained: train.Trained) -> DataFrame:
        labels = LABELS if variant["label_kind"] == "sentiment" else (0, 1)
        sums = model.label_sums(trained.judged.filter(F.col("split") == "train"), labels)
        fit = sums.agg(F.sum("rows").alias("train_rows"), F.max(F.abs(F.col("rows") - F.col("expected"))).alias("off"))
        dev = trained.path.filter("chosen").select("penalty", F.col("rows").alias("dev_rows"), "accuracy", "loss")
        both = fit.withColumn("one", F.lit(1)).join(dev.withColumn("one", F.lit(1)), "one").drop("one")
        return both.select(*[F.lit(v).alias(k) for k, v in variant.items()], "*")

    return reduce(DataFrame.unionAll, [measured(*run) for run in runs])


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        kept_articles, site_list, site_union, text_scan, labelled_scan, page_text, page_article, collect_known,
        collect_listed, collect_stored, article_sink, clean_corpus_job, incremental_append, incremental_stream,
        tokenize, host_extract, host_exclude, seen_url_anti, strip_control, strip_literal_token,
        strip_listed_tokens, min_words, min_chars, site_scored, unscored_report, polarity,
        constant_score, content_key, name_roundtrip, hash_split, example_projection, label_index,
        label_names, drop_reasons, site_counts, site_rollup, polarity_counts, corpus_counts,
        load_counts, token_frequency, token_frequency_neg, shuffled, sample_n, split_slices,
        preview, exact_dedupe, dedupe_texts, cleaned_dedupe, combined_corpus, labelled_concat,
        vocabulary, encode_single, encode_clustered, encode_quality, encode_pair, subword_vocabulary, encode_subword,
        basic_tokens, encode_basic,
        linear_head, one_hot, cross_entropy, mean_loss, accuracy, binary_counts, prf1, hard_auc,
        score_auc, threshold_curve, best_threshold, confusion, variant_counts, train_softmax, train_evaluate, train_scores,
        penalty_path, predict_batch, variant_runs,
    )
}
