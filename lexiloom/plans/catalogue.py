"""Queries over the driver's tables, by name, and the SQL that gives the same rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from lexiloom.functions import encoding, morphology, text
from lexiloom.operators import analysis, datasets, documents, lexicon, metrics, pretraining, qa, tokenizer, vocab, wordpiece
from lexiloom.sources import corpus, readers, sinks
from lexiloom.storage import checkpoint_dir, materialize

#: A harmless list for the word filters.
LISTED = ("stupid", "worthless", "pathetic")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

SENTENCES = "s AS (SELECT doc_id, lang, source, unnest(string_split(text, chr(10))) AS sentence, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)"
RE2_WORD = r"\p{L}\p{N}_"
# How RE2, which has no class intersection, writes the unprintable characters.
RE2_UNPRINTABLE = r"[\p{Cc}\p{Cf}\p{Co}\p{Zl}\p{Zp}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]"


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").withColumn("sentences", F.split("text", "\n"))


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.explode_sentences(docs(spark, sf_dir).select("doc_id", "lang", "source", "sentences"))
    return rows.withColumnRenamed("sent_idx", "i")


@query(
    rf"""
WITH {SENTENCES}, kept AS (
  SELECT * FROM s WHERE length(sentence) BETWEEN 10 AND 200 AND NOT regexp_matches(sentence, '[{RE2_WORD}\-]+@[{RE2_WORD}\-]+\.[{RE2_WORD}.\-]+')
), d AS (SELECT doc_id, lang, count(*) AS n FROM kept GROUP BY ALL HAVING count(*) >= 5 AND NOT bool_or(regexp_matches(sentence, '[{{|}}]')))
SELECT lang, count(*) AS n_docs, sum(n)::BIGINT AS n_sentences FROM d GROUP BY lang
"""
)
def clean_flagship(spark, sf_dir):
    kept = documents.clean(docs(spark, sf_dir), sentence_filters=["email", "sequence_length"], document_filters=["short_document", "script"])
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("sentences")).alias("n_sentences"))


@query(
    rf"""
WITH {SENTENCES}, d AS (
  SELECT doc_id, count(*) AS n_all, count(*) FILTER (WHERE length(sentence) BETWEEN 10 AND 200) AS n, bool_or(length(sentence) BETWEEN 10 AND 200 AND regexp_matches(sentence, '[{{|}}]')) AS script FROM s GROUP BY doc_id
)
SELECT count(*) AS n_before, count(*) FILTER (WHERE n >= 5 AND NOT script) AS n_after, count(*) FILTER (WHERE n < 5) AS n_short_document, count(*) FILTER (WHERE script) AS n_script,
  sum(n_all)::BIGINT AS n_sentences_before, coalesce(sum(n) FILTER (WHERE n >= 5 AND NOT script), 0)::BIGINT AS n_sentences_after FROM d
"""
)
def clean_counts(spark, sf_dir):
    """What each filter drops, and what stays, from one pass over the documents."""
    return documents.clean_counts(docs(spark, sf_dir), ["short_document", "script"], sentence_filters=["sequence_length"])


@query(rf"WITH u AS (SELECT url AS x FROM pages UNION ALL SELECT unnest(string_split(text, chr(10))) FROM documents) SELECT regexp_matches(x, '(https?|sftp?)://[{RE2_WORD}/:%#$&?()~.=+\-]+') AS has_url, count(*) AS n, sum(length(x))::BIGINT AS chars FROM u GROUP BY 1")
def filter_url(spark, sf_dir):
    rows = read(spark, sf_dir, "pages").select(F.col("url").alias("x")).union(sentences(spark, sf_dir).select("sentence"))
    return rows.groupBy(text.has_url(F.col("x")).alias("has_url")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("x")).alias("chars"))


@query(rf"WITH {SENTENCES} SELECT doc_id, i::INT AS i FROM s WHERE regexp_matches(sentence, '[{RE2_WORD}\-]+@[{RE2_WORD}\-]+\.[{RE2_WORD}.\-]+')")
def filter_email(spark, sf_dir):
    return sentences(spark, sf_dir).where(text.has_email(F.col("sentence"))).select("doc_id", "i")


@query(f"WITH {SENTENCES} SELECT lang, count(*) AS n FROM s WHERE length(sentence) BETWEEN 10 AND 200 GROUP BY lang")
def filter_length(spark, sf_dir):
    return sentences(spark, sf_dir).where(~text.bad_length(F.col("sentence"))).groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SENTENCES} SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id HAVING count(*) >= 5")
def filter_short_doc(spark, sf_dir):
    kept = documents.clean(docs(spark, sf_dir), document_filters=["short_document"])
    return kept.select("doc_id", F.size("sentences").cast("long").alias("n"))


@query(f"WITH {SENTENCES} SELECT doc_id FROM s GROUP BY doc_id HAVING NOT bool_or(regexp_matches(sentence, '[{{|}}]'))")
def filter_script(spark, sf_dir):
    return documents.clean(docs(spark, sf_dir), document_filters=["script"]).select("doc_id")


def morphemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a morpheme, with what the counts need of it."""
    return sentences(spark, sf_dir).select("doc_id", "lang", "i", F.posexplode(analysis.regex_words(F.col("sentence"))).alias("pos", "surface"))


_MORPHEMES = rf"m AS (SELECT doc_id, lang, i, unnest(ws) AS surface, unnest(range(0, len(ws))) AS pos FROM (SELECT *, regexp_extract_all(sentence, '[{RE2_WORD}]+|[^{RE2_WORD}\s]') AS ws FROM s))"


@query(f"WITH {SENTENCES}, {_MORPHEMES} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m WHERE surface IN {LISTED})")
def filter_ng_words(spark, sf_dir):
    words = spark.range(1).select(F.explode(F.array(*map(F.lit, LISTED))).alias("word"))
    found = morphemes(spark, sf_dir).select("doc_id", "surface")
    return documents.drop_ng_documents(read(spark, sf_dir, "documents").select("doc_id"), found, words)


@query(f"WITH {SENTENCES}, {_MORPHEMES} SELECT DISTINCT doc_id FROM m WHERE surface IN {LISTED}")
def filter_ng_words_exact(spark, sf_dir):
    rows = sentences(spark, sf_dir).where(F.col("sentence").rlike(documents.ng_pattern(LISTED)))  # the cheap test comes first
    hit = documents.has_ng_word(F.col("sentence"), analysis.regex_morphemes(F.col("sentence")), LISTED)
    return rows.where(hit).select("doc_id").distinct()


DECORATE = "concat('a', chr(9), ' x ', chr(160), sentence, chr(12288), '  b')"


@query(
    rf"""
WITH {SENTENCES}, n AS (SELECT doc_id, i::INT AS i, regexp_replace(regexp_replace({DECORATE}, '{RE2_UNPRINTABLE}', '', 'g'), ' +', ' ', 'g') AS x FROM s)
SELECT doc_id, i, md5(x) AS digest, length(x)::INT AS n FROM n
"""
)
def norm_whitespace(spark, sf_dir):
    dirty = F.concat(F.lit("a\t x  "), "sentence", F.lit("　  b"))
    rows = sentences(spark, sf_dir).select("doc_id", "i", text.whitespace_normalizer(dirty).alias("x"))
    return rows.select("doc_id", "i", F.md5(F.col("x").cast("binary")).alias("digest"), F.char_length("x").alias("n"))


@query(
    rf"""
WITH {SENTENCES}, n AS (SELECT doc_id, i::INT AS i, regexp_replace(concat('[12]', left(sentence, 5), '[要出典]{{{{x', i, '}}}}', substr(sentence, 6), '[a] b?]'), '\[\p{{Nd}}+?\]|\[要.+?\]|\{{\{{+[^{{}}]+?\}}\}}+|\[(要出典|リンク切れ|.+?\?)\]', '', 'g') AS x FROM s)
SELECT doc_id, i, md5(x) AS digest, length(x)::INT AS n FROM n
"""
)
def norm_citation(spark, sf_dir):
    rows = sentences(spark, sf_dir)
    dirty = F.concat(F.lit("[12]"), F.substring("sentence", 1, 5), F.lit("[要出典]{{x"), F.col("i").cast("string"), F.lit("}}"), F.expr("substring(sentence, 6)"), F.lit("[a] b?]"))
    rows = rows.select("doc_id", "i", text.citation_normalizer(dirty).alias("x"))
    return rows.select("doc_id", "i", F.md5(F.col("x").cast("binary")).alias("digest"), F.char_length("x").alias("n"))


@query(
    f"""
WITH {SENTENCES}, g AS (SELECT *, sum(CASE WHEN i = 0 OR length(sentence) > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM s),
j AS (SELECT doc_id, g, string_agg(sentence, '' ORDER BY i) AS x FROM g GROUP BY ALL)
SELECT doc_id, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY g)) AS digest FROM j GROUP BY doc_id
"""
)
def concat_short(spark, sf_dir):
    rows = documents.clean(docs(spark, sf_dir), document_normalizers=["concat_short_sentence"], concat_char_num=20)
    return rows.select("doc_id", F.size("sentences").cast("long").alias("n"), F.md5(F.array_join("sentences", "\n").cast("binary")).alias("digest"))


@query(
    """
WITH RECURSIVE e AS (SELECT doc_id, sum(len(string_split(text, chr(10))) + 1) OVER (ORDER BY doc_id) AS stop FROM documents),
cuts AS (SELECT 0::HUGEINT AS cut UNION ALL SELECT (SELECT min(stop) FROM e WHERE stop - cut > 1000) FROM cuts WHERE (SELECT min(stop) FROM e WHERE stop - cut > 1000) IS NOT NULL)
SELECT doc_id, (SELECT count(*) FROM cuts WHERE cut < stop) AS shard_id FROM e
"""
)
def shard_greedy(spark, sf_dir):
    return documents.shard_ids(docs(spark, sf_dir).select("doc_id", "sentences"), "doc_id", 1000).select("doc_id", F.col("shard_id").cast("long").alias("shard_id"))


@query("SELECT doc_id, 1::INT AS n_paragraphs, len(string_split(text, chr(10)))::INT AS n_parts, md5(replace(text, chr(10), '|')) AS digest FROM documents")
def article_paragraphs(spark, sf_dir):
    lines = F.array(F.lit(""), F.lit(documents.ARTICLE), F.lit("title"), F.lit(documents.PARAGRAPH), F.replace("text", F.lit("\n"), F.lit(documents.NEWLINE)))
    found = documents.article_paragraphs(F.array_join(lines, "\n"))
    rows = read(spark, sf_dir, "documents").select("doc_id", found.alias("p"))
    return rows.select("doc_id", F.size("p").alias("n_paragraphs"), F.size(F.flatten("p")).alias("n_parts"), F.md5(F.array_join(F.flatten("p"), "|").cast("binary")).alias("digest"))


@query(f"WITH {SENTENCES} SELECT doc_id, count(*) AS n, md5(string_agg(sentence, chr(10) ORDER BY i)) AS digest FROM s GROUP BY doc_id")
def nest_again(spark, sf_dir):
    rows = documents.nest_sentences(sentences(spark, sf_dir).withColumnRenamed("i", "sent_idx"), ["doc_id"])
    return rows.select("doc_id", F.size("sentences").cast("long").alias("n"), F.md5(F.array_join("sentences", "\n").cast("binary")).alias("digest"))


_COUNTED = f"{_MORPHEMES}, c AS (SELECT lower(surface) AS word, count(*) AS freq, min((doc_id, i, pos)) AS first FROM m GROUP BY 1)"


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lower-cased words of all sentences, counted."""
    words = F.transform(analysis.regex_words(F.col("sentence")), F.lower)
    return vocab.array_counts(sentences(spark, sf_dir).select("doc_id", "i", words.alias("words")), "words", ["doc_id", "i"])


@query(f"WITH {SENTENCES}, {_COUNTED} SELECT row_number() OVER (ORDER BY freq DESC, first) - 1 AS rank, word, freq FROM c ORDER BY freq DESC, first LIMIT 500")
def vocab_top(spark, sf_dir):
    return vocab.top_words(counted(spark, sf_dir), size=500)


@query(
    f"""WITH {SENTENCES}, {_COUNTED}, k AS (SELECT * FROM c WHERE freq >= 3), one AS (SELECT * FROM k WHERE length(word) = 1 ORDER BY freq DESC, first LIMIT 20),
v AS (SELECT * FROM k WHERE length(word) <> 1 UNION ALL SELECT * FROM one) SELECT word, freq FROM v"""
)
def vocab_char_cap(spark, sf_dir):
    return vocab.top_words(counted(spark, sf_dir), least=3, most_characters=20).select("word", "freq")


@query(f"WITH {SENTENCES}, {_COUNTED} SELECT freq, count(*) AS n FROM c WHERE freq >= 2 GROUP BY freq")
def vocab_min_freq(spark, sf_dir):
    return vocab.top_words(counted(spark, sf_dir), least=2).groupBy("freq").agg(F.count(F.lit(1)).alias("n"))


def surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(word, freq): every morpheme of the sentences once, as it is written; analysed alone it stays one morpheme."""
    rows = sentences(spark, sf_dir).select("doc_id", analysis.regex_words(F.col("sentence")).alias("words"))
    return vocab.array_counts(rows, "words", ["doc_id"]).select("word", "freq")


_KIND = rf"CASE WHEN regexp_full_match(surface, '\p{{N}}+') THEN '[number]' WHEN regexp_matches(surface, '^[{RE2_WORD}]') THEN '[noun]' ELSE '[symbol]' END"
_VOCAB = f"""{_COUNTED}, t AS (SELECT DISTINCT {_KIND} AS tag FROM m), w AS (SELECT word, row_number() OVER (ORDER BY freq DESC, first) AS r FROM c ORDER BY freq DESC, first LIMIT 300),
u AS (SELECT 0 AS a, n AS b, s AS token FROM (VALUES (0, '[PAD]'), (1, '[UNK]'), (2, '[CLS]'), (3, '[SEP]'), (4, '[MASK]')) x(n, s)
  UNION ALL SELECT 1, row_number() OVER (ORDER BY tag), tag FROM t UNION ALL SELECT 2, r, word FROM w),
v AS (SELECT (row_number() OVER (ORDER BY a, b) - 1)::INT AS id, token FROM u)"""


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specials, tags, and the 300 most frequent words; the corpus is analysed once, to its distinct words."""
    counts = materialize(counted(spark, sf_dir), "counts")
    kind = F.array(analysis.regex_kind(F.col("word")), *[F.lit("*")] * 5)
    tags = vocab.pos_tags(counts.select(morphology.pos_tag(kind).alias("tag")))
    return vocab.assembled(spark, vocab.SPECIALS, tags, vocab.top_words(counts, size=300))


@query(f"WITH {SENTENCES}, {_VOCAB} SELECT id, token FROM v")
def vocab_pos(spark, sf_dir):
    return vocabulary(spark, sf_dir)


@query(
    f"""WITH {SENTENCES}, {_VOCAB}, x AS (SELECT doc_id, i, pos, CASE WHEN lower(surface) IN (SELECT token FROM v) THEN lower(surface) ELSE {_KIND} END AS token FROM m)
SELECT token, count(*) AS n FROM x GROUP BY token"""
)
def pos_substitute(spark, sf_dir):
    known = vocab.lookup(vocabulary(spark, sf_dir))
    found = F.transform("w", lambda w: F.struct(F.array(analysis.regex_kind(w), *[F.lit("*")] * 5).alias("pos")))
    words = surfaces(spark, sf_dir).select("freq", F.array("word").alias("w"))
    tokens = words.select("freq", F.explode(encoding.pos_substituted(F.transform("w", F.lower), found, known)).alias("token"))
    return tokens.groupBy("token").agg(F.sum("freq").alias("n"))


@query(
    f"""WITH {SENTENCES}, {_VOCAB}, x AS (SELECT doc_id, i, pos, coalesce(v.id, 1) AS id FROM m LEFT JOIN v ON v.token = lower(surface)),
e AS (SELECT doc_id, i, string_agg(id::VARCHAR, ',' ORDER BY pos) || ',' AS ids, count(*) AS n FROM x GROUP BY ALL),
a AS (SELECT s.doc_id, s.i, coalesce(ids, '') AS ids, coalesce(n, 0) AS n FROM s LEFT JOIN e ON e.doc_id = s.doc_id AND e.i = s.i)
SELECT doc_id, i::INT AS i, md5('2,' || ids || '3') AS ids, n + 2 AS n, '1' || repeat('0', n::INT) || '1' AS mask, repeat('0', n::INT + 2) AS types FROM a"""
)
def encode_ids(spark, sf_dir):
    """Every sentence, however long, and those without a token."""
    known = vocab.lookup(vocabulary(spark, sf_dir))
    words = F.transform(analysis.regex_words(F.col("sentence")), F.lower)
    rows = sentences(spark, sf_dir).withColumn("ids", known.ids(words))
    return rows.select(
        "doc_id",
        "i",
        F.md5(F.array_join(encoding.with_specials(F.col("ids"), cls=2, sep=3), ",").cast("binary")).alias("ids"),
        (F.size("ids") + 2).cast("long").alias("n"),
        F.array_join(encoding.special_mask(F.col("ids")), "").alias("mask"),
        F.array_join(encoding.token_types(F.col("ids")), "").alias("types"),
    )




@query(
    f"""WITH {SENTENCES}, {_VOCAB}, ch AS (SELECT token FROM v WHERE length(token) = 1), x AS (SELECT unnest(string_split(lower(surface), '')) AS c FROM m)
SELECT CASE WHEN c IN (SELECT token FROM ch) THEN c ELSE '[UNK]' END AS token, count(*) AS n FROM x WHERE c <> '' GROUP BY 1"""
)
def character_subwords(spark, sf_dir):
    chars = vocab.lookup(vocabulary(spark, sf_dir).where(F.char_length("token") == 1))
    words = surfaces(spark, sf_dir)
    rows = words.select("freq", F.explode(encoding.character_subwords(F.array(F.lower("word")), chars)).alias("token"))
    return rows.groupBy("token").agg(F.sum("freq").alias("n"))


@query(
    """SELECT doc_id, md5(translate(x, '！＂＃＄％＆＇（）＊＋，－．／０１２３４５６７８９：；＜＝＞？＠ＡＢＣＤＥＦＧＨＩＪＫＬＭＮＯＰＱＲＳＴＵＶＷＸＹＺ［＼］＾＿｀ａｂｃｄｅｆｇｈｉｊｋｌｍｎｏｐｑｒｓｔｕｖｗｘｙｚ｛｜｝～',
  '!"#$%&''()*+,-./0123456789:;<=>?@ABCDEFGHIJKLMNOPQRSTUVWXYZ[\\]^_`abcdefghijklmnopqrstuvwxyz{|}~')) AS digest FROM (SELECT doc_id, text || 'Ａ１～　' AS x FROM documents)""".replace("\\\\", "\\")
)
def half_ascii(spark, sf_dir):
    wide = F.concat("text", F.lit("Ａ１～　"))
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.half_ascii(wide).cast("binary")).alias("digest"))


@query()
def nfkc(spark, sf_dir):
    normal = text.input_normalizer(do_strip=True, do_lower_case=True, do_nfkc=True)
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(normal(F.col("text")).cast("binary")).alias("digest"))


@query()
def wordpiece_tokens(spark, sf_dir):
    """Pieces of every word by a vocabulary trained on all words, of the trainer's own size and alphabet."""
    counts = materialize(counted(spark, sf_dir).select("word", "freq"), "counts")
    trained = vocab.train_wordpiece(counts)
    pieces = vocab.wordpiece_of_words(counts, trained)
    rows = counts.join(pieces, "word").select("freq", F.explode("pieces").alias("piece"))
    return rows.groupBy("piece").agg(F.sum("freq").alias("n"))


@query()
def wordpiece_rounds(spark, sf_dir):
    """A small vocabulary trained over all words in tables: ids and tokens. Words of three occurrences and more keep the rounds short."""
    counts = materialize(counted(spark, sf_dir).where("freq >= 3").select("word", "freq"), "counts")
    tokens = wordpiece.train_distributed(counts, 220, 1, 5000, vocab.SPECIALS)
    return spark.createDataFrame(list(enumerate(tokens)), "id int, token string")


_SPLIT = "[p for p in ['un', 'the', 'tion', 'er', 'en', 'es', 'th', 'an', 'a', 'e', 'h', 'i', 'n', 'o', 'r', 's', 't', '##tion', '##ed', '##er', '##en', '##th', '##an', '##h', '##a', '##e', '##i', '##n', '##o', '##r', '##s', '##t', '##ing']]"
#: Pieces of a made vocabulary; most words of English prose here take several.
PIECES = tuple(re.findall(r"'([^']+)'", _SPLIT))


@query(
    f"""
WITH RECURSIVE {SENTENCES}, {_MORPHEMES}, words AS (SELECT lower(surface) AS word, count(*) AS freq FROM m GROUP BY 1), p AS (SELECT unnest({_SPLIT}) AS piece),
cut AS (
  SELECT word, 0 AS pos, []::VARCHAR[] AS pieces FROM words WHERE length(word) <= 100
  UNION ALL
  SELECT word, pos + n, list_append(pieces, piece) FROM (
    SELECT word, pos, pieces, piece, length(replace(piece, '##', '')) AS n, max(length(replace(piece, '##', ''))) OVER (PARTITION BY word, pos) AS longest
    FROM cut JOIN p ON (CASE WHEN pos > 0 THEN '##' ELSE '' END || substr(word, pos + 1, length(replace(piece, '##', '')))) = piece AND pos + length(replace(piece, '##', '')) <= length(word)
  ) WHERE n = longest
),
done AS (SELECT words.word, freq, coalesce(pieces, ['[UNK]']) AS pieces FROM words LEFT JOIN cut ON cut.word = words.word AND pos = length(words.word))
SELECT piece, sum(freq)::BIGINT AS n FROM (SELECT unnest(pieces) AS piece, freq FROM done) GROUP BY piece
"""
)
def wordpiece_split(spark, sf_dir):
    """Every word in the longest pieces of a made vocabulary, continuations among them."""
    counts = materialize(counted(spark, sf_dir).select("word", "freq"), "counts")
    rows = counts.join(vocab.wordpiece_of_words(counts, PIECES), "word").select("freq", F.explode("pieces").alias("piece"))
    return rows.groupBy("piece").agg(F.sum("freq").alias("n"))


@query("SELECT c_custkey AS id, CASE WHEN r <= n - held THEN 'train' WHEN r <= n - tests THEN 'dev' ELSE 'test' END AS split FROM (SELECT *, ceil(n * 2 / 10.0) AS held, ceil(ceil(n * 2 / 10.0) / 2) AS tests FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_custkey) AS r, count(*) OVER () AS n FROM customer))")
def split_ratio(spark, sf_dir):
    return datasets.split_by_ratio(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id", "8/1/1")


@query("SELECT CASE WHEN d < '1994' THEN 'train' WHEN d < '1996' THEN 'dev' ELSE 'test' END AS split, count(*) AS n FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) GROUP BY 1")
def split_range(spark, sf_dir):
    rows = read(spark, sf_dir, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return rows.groupBy(datasets.split_by_range(F.col("d"), "1994", "1996").alias("split")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, count(*) AS n, md5(string_agg(text, chr(10) ORDER BY turn, text)) AS digest FROM conversations WHERE text IS NOT NULL GROUP BY conv_id")
def conversation_docs(spark, sf_dir):
    rows = readers.conversations(read(spark, sf_dir, "conversations").where("text IS NOT NULL"))
    return rows.select("conv_id", F.size("sentences").cast("long").alias("n"), F.md5(F.array_join("sentences", "\n").cast("binary")).alias("digest"))


#: Tokens of the made contexts are so wide, and spell their places.
WIDTH = 8


def nbest(spark: SparkSession, sf_dir: str) -> DataFrame:
    logits = F.transform("embedding", lambda x: x.cast("double"))
    n = F.size("embedding")
    places = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i > 0, F.struct((i * WIDTH).alias("start"), ((i + 1) * WIDTH).alias("end"))))
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.lit(0).alias("feature_idx"), logits.alias("start_logits"), F.reverse(logits).alias("end_logits"), places.alias("offsets"), n.alias("n"))
    context = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.lpad(i.cast("string"), WIDTH, " ")), "")
    return qa.answers(rows.drop("n"), rows.select("id", context.alias("context")))


def token_range(chosen: Column) -> Column:
    """An answer's text as its first and last token's places."""
    first, last = F.trim(F.substring(chosen, 1, WIDTH)), F.trim(F.right(chosen, F.lit(WIDTH)))
    return F.when(chosen == "", "").otherwise(F.concat(first, F.lit("-"), last))


@query(
    """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), x AS (SELECT vec_id, v, len(v) AS n FROM e),
s AS (SELECT vec_id, k - 1 AS s, v[k] AS l, row_number() OVER (PARTITION BY vec_id ORDER BY v[k] DESC, k) AS r FROM (SELECT vec_id, v, unnest(range(1, n + 1)) AS k FROM x) QUALIFY r <= 20),
t AS (SELECT vec_id, k - 1 AS e, v[n + 1 - k] AS l, row_number() OVER (PARTITION BY vec_id ORDER BY v[n + 1 - k] DESC, k) AS r FROM (SELECT vec_id, v, n, unnest(range(1, n + 1)) AS k FROM x) QUALIFY r <= 20),
p AS (SELECT s.vec_id, s, e, s.l + t.l AS score FROM s JOIN t USING (vec_id) WHERE e >= s AND e - s + 1 <= 30 AND s >= 1 AND e >= 1),
b AS (SELECT vec_id, max_by({'s': s, 'e': e, 'score': score}, (score, -s, -e)) AS b FROM p GROUP BY vec_id)
SELECT vec_id AS id, CASE WHEN b IS NULL OR v[1] + v[n] - b.score > 0 THEN '' ELSE b.s || '-' || b.e END AS chosen FROM x LEFT JOIN b USING (vec_id)
"""
)
def qa_nbest(spark, sf_dir):
    return nbest(spark, sf_dir).select("id", token_range(F.col("chosen")).alias("chosen")).distinct()


_PREDICTED = "p AS (SELECT l.doc_id, l.quality AS label, CASE WHEN regexp_matches(text, '[|!*]') THEN 0 ELSE 1 END AS prediction, source AS setting, CASE WHEN doc_id % 2 = 0 THEN 'Dev' ELSE 'Test' END AS stage FROM labels l JOIN documents USING (doc_id))"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "labels").join(read(spark, sf_dir, "documents"), "doc_id")
    return rows.select(
        "doc_id",
        F.col("quality").alias("label"),
        F.when(F.col("text").rlike("[|!*]"), 0).otherwise(1).alias("prediction"),
        F.col("source").alias("setting"),
        F.when(F.col("doc_id") % 2 == 0, "Dev").otherwise("Test").alias("stage"),
    )


@query(
    f"""WITH {_PREDICTED} SELECT setting, round(avg((label = prediction)::DOUBLE) FILTER (WHERE stage = 'Dev'), 9) AS dev_accuracy, round(avg((label = prediction)::DOUBLE) FILTER (WHERE stage = 'Test'), 9) AS test_accuracy,
round(avg((label - prediction) ** 2), 9)::DOUBLE AS mse, round(avg(abs(label - prediction)), 9)::DOUBLE AS mae FROM p GROUP BY setting"""
)
def metric_summary(spark, sf_dir):
    rows = predictions(spark, sf_dir)
    hit = rows.withColumn("hit", (F.col("label") == F.col("prediction")).cast("double"))
    wide = metrics.summary(hit, ["setting"], "stage", ["Dev", "Test"], ["hit"]).toDF("setting", "dev_accuracy", "test_accuracy")
    errors = rows.groupBy("setting").agg(metrics.squared_error(F.col("label"), F.col("prediction")).alias("mse"), metrics.absolute_error(F.col("label"), F.col("prediction")).alias("mae"))
    rounded = [F.round(c, 9).alias(c) for c in ("dev_accuracy", "test_accuracy", "mse", "mae")]
    return wide.join(errors, "setting").select("setting", *rounded)


@query(f"WITH {_PREDICTED}, a AS (SELECT setting, round(avg((label = prediction)::DOUBLE), 9) AS value FROM p WHERE stage = 'Dev' GROUP BY setting) SELECT setting, value FROM a ORDER BY value DESC, setting LIMIT 1")
def best_model(spark, sf_dir):
    rows = predictions(spark, sf_dir).where("stage = 'Dev'").groupBy("setting").agg(F.round(metrics.accuracy(F.col("label"), F.col("prediction")), 9).alias("value"))
    return metrics.best_setting(rows, "setting", "value")


_WHOLE_TEXTS = "d AS (SELECT d.doc_id, d.text AS a, coalesce(e.text, '') AS b FROM documents d LEFT JOIN documents e ON e.doc_id = d.doc_id + 1)"


@query(
    f"""
WITH {_WHOLE_TEXTS}, n AS (
  SELECT doc_id, trim(regexp_replace(regexp_replace(lower(a), '。+$', ''), '[\\s\\x{{A0}}]+', ' ', 'g')) AS a, trim(regexp_replace(regexp_replace(lower(b), '。+$', ''), '[\\s\\x{{A0}}]+', ' ', 'g')) AS b FROM d
), c AS (SELECT doc_id, 'a' AS k, unnest(string_split(a, '')) AS ch FROM n UNION ALL SELECT doc_id, 'b', unnest(string_split(b, '')) FROM n),
m AS (SELECT doc_id, ch, count(*) FILTER (WHERE k = 'a') AS x, count(*) FILTER (WHERE k = 'b') AS y FROM c WHERE ch <> '' GROUP BY ALL),
f AS (SELECT doc_id, sum(least(x, y)) AS same, sum(x) AS x, sum(y) AS y FROM m GROUP BY doc_id)
SELECT doc_id, round(CASE WHEN x = 0 OR y = 0 THEN (x = y)::DOUBLE WHEN same = 0 THEN 0.0 ELSE 2.0 * (same / y) * (same / x) / (same / y + same / x) END, 9)::DOUBLE AS f1 FROM f
"""
)
def char_f1(spark, sf_dir):
    """Characters of each whole text against those of the next document's."""
    rows = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("a"))
    after = rows.select((F.col("doc_id") - 1).alias("doc_id"), F.col("a").alias("b"))
    rows = rows.join(after, "doc_id", "left").select("doc_id", "a", F.coalesce("b", F.lit("")).alias("b"))
    return rows.select("doc_id", F.round(metrics.overlap_f1(F.col("a"), F.col("b"), metrics.answer_characters), 9).alias("f1"))




@query("SELECT lang AS label, row_number() OVER (ORDER BY lang) - 1 AS id FROM (SELECT DISTINCT lang FROM documents)")
def label_ids(spark, sf_dir):
    rows = datasets.label_ids(read(spark, sf_dir, "documents").select(F.col("lang").alias("label")))
    return rows.withColumn("id", F.col("id").cast("long"))


@query(
    """
WITH r AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id), q AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k, text, turn FROM conversations WHERE text IS NOT NULL)
SELECT conv_id || lpad(k::VARCHAR, 4, '0') AS id, CASE WHEN turn < 1 THEN 0 ELSE 1 END AS n_answers, CASE WHEN turn < 1 THEN -1 ELSE 0 END AS answer_start, split
FROM q JOIN (SELECT conv_id, CASE WHEN conv_id::VARCHAR < '2' THEN 'train' WHEN conv_id::VARCHAR < '3' THEN 'dev' ELSE 'test' END AS split FROM r) USING (conv_id)
"""
)
def convert_reading(spark, sf_dir):
    turns = read(spark, sf_dir, "conversations").where("text IS NOT NULL")
    nested = F.array_sort(F.collect_list(F.struct("turn", "text")))
    nested = F.transform(nested, lambda t: F.struct(t["text"].alias("text"), F.when(t["turn"] < 1, 1).otherwise(2).alias("score")))
    rows = turns.groupBy("conv_id").agg(nested.alias("documents")).select(F.col("conv_id").cast("string").alias("qid"), F.lit("who").alias("question"), F.lit("").alias("answer"), F.when(F.col("conv_id").cast("string") < "2", "2008").when(F.col("conv_id").cast("string") < "3", "2009").otherwise("2010").alias("timestamp"), "documents")
    out = datasets.convert_reading(rows)
    return out.select("id", F.size("answers.text").alias("n_answers"), F.coalesce(F.get("answers.answer_start", F.lit(0)), F.lit(-1)).alias("answer_start"), "split")


@query(
    """
WITH w AS (SELECT doc_id, len(regexp_extract_all(text, '[^ \\n]+')) AS n FROM documents), f AS (SELECT doc_id, n, unnest(range(0, greatest(ceil((n - 59) / 39.0), 0)::INT + 1)) AS k FROM w)
SELECT doc_id, k::INT AS feature_idx, greatest(least(59, n - k * 39), 0)::INT AS n FROM f
""".replace("\\\\", "\\")
)
def qa_features(spark, sf_dir):
    words = F.regexp_extract_all("text", F.lit("[^ \n]+"), F.lit(0))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.array(F.lit("what"), F.lit("?")).alias("q"), words.alias("c"), F.transform(words, lambda w, i: i).alias("o"))
    out = qa.overflow_features(rows, "q", "c", "o", length=64, stride=20)
    return out.select("doc_id", "feature_idx", F.size("chunk").alias("n"))


@query("SELECT p.o_orderpriority || '_' || r.r_name || '_' || n.l_linenumber AS setting FROM (SELECT DISTINCT o_orderpriority FROM orders) p, region r, (SELECT DISTINCT l_linenumber FROM lineitem) n")
def parameter_grid(spark, sf_dir):
    """Every combination of three tables' few values."""
    values = lambda name, c: [r[0] for r in read(spark, sf_dir, name).select(c).distinct().orderBy(c).collect()]
    grid = datasets.parameter_grid(spark, batch=values("orders", "o_orderpriority"), rate=values("region", "r_name"), epochs=values("lineitem", "l_linenumber"))
    return grid.select(F.concat_ws("_", "batch", "rate", "epochs").alias("setting"))


@query("WITH s AS (SELECT conv_id, turn, role, text FROM conversations) SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'a' ELSE 'b' END AS choice, position(CASE WHEN role = 'user' THEN 'a' ELSE 'b' END IN 'abcd')::INT - 1 AS label FROM s")
def letter_labels(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("role") == "user", "a").otherwise("b").alias("choice"))
    return rows.withColumn("label", datasets.letter_index(F.col("choice")))


@query(
    """WITH k AS (SELECT doc_id, text, list_max(list_filter(range(0, 1001), lambda k: strlen(left(text, k)) <= 1000)) AS k FROM documents)
SELECT doc_id, strlen(left(text, k)) AS n, length(left(text, k)) AS chars FROM k"""
)
def truncate_bytes(spark, sf_dir):
    """All documents, cut on bytes, so that cuts fall inside characters too."""
    cut = text.truncate_utf8(F.col("text"), 1000)
    return read(spark, sf_dir, "documents").select("doc_id", F.octet_length(cut).cast("long").alias("n"), F.char_length(cut).cast("long").alias("chars"))




# -- word forms, over morphemes made of the parts table ---------------------------

_FORMS = """m AS (SELECT p_partkey AS id, p_size, p_name || 'Ａ１' AS surface, p_brand || 'Ｂ' AS dict, p_type || 'る' AS norm,
  CASE p_size % 4 WHEN 0 THEN '動詞' WHEN 1 THEN '形容詞' WHEN 2 THEN '助動詞' ELSE '名詞' END AS c0,
  CASE p_size % 3 WHEN 0 THEN 'サ行変格' WHEN 1 THEN '五段' ELSE '*' END AS c4,
  CASE p_size % 5 WHEN 0 THEN '終止形-一般' WHEN 1 THEN '連用形-一般' WHEN 2 THEN '仮定形-一般' ELSE '*' END AS c5 FROM part),
p AS (SELECT *, c0 <> '名詞' AS conj, c0 <> '名詞' AND (c4 = 'サ行変格' OR c5 <> '終止形-一般') AS needs FROM m)"""
_HALF = "translate({}, 'Ａ１Ｂ', 'A1B')"
_RULES = {"動詞": {"五段|連用形-一般": [["xx", "y"], ["る", "り"]], "サ行変格|終止形-一般": [["る", "す"]], "五段|仮定形-一般": [["", ""]]}, "形容詞": {"*|連用形-一般": [["Yる", "Yく"]]}}


def made_morphemes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    pick = lambda by, *values: F.element_at(F.array(*map(F.lit, values)), (size % by + 1).cast("int"))
    pos = F.array(
        pick(4, "動詞", "形容詞", "助動詞", "名詞"), *[F.lit("*")] * 3, pick(3, "サ行変格", "五段", "*"), pick(5, "終止形-一般", "連用形-一般", "仮定形-一般", "*", "*")
    )
    fields = {"surface": F.concat("p_name", F.lit("Ａ１")), "dictionary_form": F.concat("p_brand", F.lit("Ｂ")), "normalized_form": F.concat("p_type", F.lit("る")), "reading_form": F.col("p_name")}
    one = F.struct(*[v.alias(k) for k, v in fields.items()], pos.alias("pos"), F.lit(0).alias("begin"), F.char_length(fields["surface"]).alias("end"))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array(one.cast(analysis.MORPHEMES[6:-1])).alias("m"))


@query(
    f"""WITH {_FORMS} SELECT id, surface, dict AS dictionary, norm AS normalized, CASE WHEN conj THEN surface ELSE dict END AS dictionary_and_surface,
CASE WHEN conj THEN surface ELSE norm END AS normalized_and_surface, CASE WHEN c5 = '*' THEN norm ELSE surface END AS normalized_nouns, {_HALF.format('surface')} AS surface_half_ascii,
{_HALF.format('dict')} AS dictionary_half_ascii, CASE WHEN conj THEN {_HALF.format('surface')} ELSE {_HALF.format('dict')} END AS dictionary_and_surface_half_ascii FROM p"""
)
def word_forms(spark, sf_dir):
    return made_morphemes(spark, sf_dir).select("id", *[morphology.word_forms(F.col("m"), name)[0].alias(name) for name in morphology.WORD_FORMS])


@query(
    f"""WITH {_FORMS} SELECT id, CASE WHEN NOT needs THEN norm WHEN c0 = '動詞' AND c4 = '五段' AND c5 = '連用形-一般' THEN left(norm, -1) || 'り'
WHEN c0 = '動詞' AND c4 = 'サ行変格' AND c5 = '終止形-一般' THEN left(norm, -1) || 'す' WHEN c0 = '形容詞' AND c4 = '*' AND c5 = '連用形-一般' AND norm LIKE '%Yる' THEN left(norm, -1) || 'く' ELSE norm END AS form FROM p"""
)
def conjugated_forms(spark, sf_dir):
    rules, types = morphology.inflection_rules(_RULES), morphology.conjugation_types({})
    return made_morphemes(spark, sf_dir).select("id", morphology.word_forms(F.col("m"), "normalized_conjugation", rules=rules, types=types)[0].alias("form"))


@query(
    f"""WITH {_FORMS} SELECT id, CASE WHEN NOT needs THEN norm WHEN c0 = '動詞' AND c4 = 'サ行変格' AND c5 IN ('連用形-一般', '仮定形-一般', '*') THEN
  CASE c5 WHEN '連用形-一般' THEN left(norm, -1) || 'り' ELSE norm END WHEN c0 = '動詞' AND c4 = '五段' AND c5 = '連用形-一般' THEN left(norm, -1) || 'り' ELSE norm END AS form
FROM p"""
)
def conjugated_types(spark, sf_dir):
    """Verbs of one type that conjugate as another, by a table with an entry for every name and type; where that lacks a form, its general kind."""
    parts = read(spark, sf_dir, "part").select("p_name", "p_type").distinct()
    key = F.concat_ws("|", F.concat("p_name", F.lit("Ａ１")), "p_name", F.concat("p_type", F.lit("る")), F.lit("サ行変格"))
    types = parts.select(F.lit("動詞").alias("class"), key.alias("key"), F.lit("五段").alias("value"))
    rules = spark.range(1).selectExpr("'動詞' AS class", "'五段|連用形-一般' AS key", "array(named_struct('src', 'る', 'tgt', 'り')) AS value")
    rows = made_morphemes(spark, sf_dir).select("id", F.col("m")[0].alias("m"))
    return analysis.conjugated_by_tables(rows, rules, types).select("id", "form")


@query(f"WITH {_FORMS} SELECT conj, c5 = '*' AS plain, needs, count(*) AS n FROM p GROUP BY ALL")
def pos_predicates(spark, sf_dir):
    pos = F.col("m")[0]["pos"]
    rows = made_morphemes(spark, sf_dir).select(morphology.is_conjugative(pos).alias("conj"), morphology.has_no_form(pos).alias("plain"), morphology.needs_inflection(pos).alias("needs"))
    return rows.groupBy("conj", "plain", "needs").agg(F.count(F.lit(1)).alias("n"))


# -- analysis ---------------------------------------------------------------------

_SPANS = rf"""g AS (SELECT doc_id, i, unnest(regexp_extract_all(sentence, '[{RE2_WORD}]+|[^{RE2_WORD}\s]')) AS w, unnest(list_slice(regexp_split_to_array(sentence, '[{RE2_WORD}]+|[^{RE2_WORD}\s]'), 1, -2)) AS gap,
  unnest(range(0, len(regexp_extract_all(sentence, '[{RE2_WORD}]+|[^{RE2_WORD}\s]')))) AS pos FROM s),
o AS (SELECT doc_id, i, pos, w, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id, i ORDER BY pos) AS stop FROM g)"""


@query(f"WITH {SENTENCES}, {_SPANS} SELECT doc_id, i::INT AS i, count(*) AS n, sum(stop - length(w))::BIGINT AS begins, sum(stop)::BIGINT AS ends, sum(pos * stop)::BIGINT AS places FROM o GROUP BY doc_id, i")
def morpheme_spans(spark, sf_dir):
    """Where every morpheme of every sentence begins and ends."""
    rows = sentences(spark, sf_dir).select("doc_id", "i", F.posexplode(analysis.regex_morphemes(F.col("sentence"))).alias("pos", "m"))
    sums = [F.sum(F.col(c).cast("long")).alias(n) for c, n in (("m.begin", "begins"), ("m.end", "ends"))]
    return rows.groupBy("doc_id", "i").agg(F.count(F.lit(1)).alias("n"), *sums, F.sum(F.col("pos").cast("long") * F.col("m.end")).alias("places"))


#: A made lexicon of syllables: dearer the longer, but for some.
SYLLABLES = {w: 400 + 150 * len(w) - (350 if w in ("the", "tion", "er") else 0) for w in ("a", "e", "he", "th", "the", "er", "re", "in", "ing", "tion", "on", "ti", "an", "and", "es", "ed", "t", "n", "h")}
_COSTS = "map {" + ", ".join(f"'{w}': {c}" for w, c in SYLLABLES.items()) + "}"
_LONGEST = max(map(len, SYLLABLES))
_BEFORE = "list_filter(list_transform(range(1, 5), lambda l: {'t': cs[l] + coalesce(" + _COSTS + "[substr(sentence, i + 2 - l, l)], CASE WHEN l = 1 THEN 1000 END), 'back': -l}), lambda c: c.t IS NOT NULL AND i + 1 + c.back >= 0)"


@query(
    f"""
WITH RECURSIVE {SENTENCES}, walk AS (
  SELECT doc_id, i AS k, sentence, 0::BIGINT AS i, [0::BIGINT] AS cs, [0::BIGINT] AS ns, [0::BIGINT] AS hs FROM s
  UNION ALL
  SELECT doc_id, k, sentence, i + 1, list_slice([CASE WHEN blank THEN cs[1] ELSE best.t END] || cs, 1, {_LONGEST}), list_slice([CASE WHEN blank THEN ns[1] ELSE ns[-best.back] + 1 END] || ns, 1, {_LONGEST}),
    list_slice([CASE WHEN blank THEN hs[1] ELSE (hs[-best.back] * 31 + i + 1) % 1000003 END] || hs, 1, {_LONGEST})
  FROM (SELECT *, substr(sentence, i + 1, 1) = ' ' AS blank, list_min({_BEFORE}) AS best FROM walk WHERE i < length(sentence))
)
SELECT doc_id, k::INT AS i, ns[1] AS n, cs[1] AS cost, hs[1] AS ends FROM walk WHERE i = length(sentence)
"""
)
def lexicon_paths(spark, sf_dir):
    """The cheapest row of syllables for every sentence: how many, at what cost, and a sum that tells their ends."""
    entries = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(w).alias("surface"), F.lit(c).alias("cost")) for w, c in SYLLABLES.items()])))
    known = lexicon.lexicon_of(entries, unknown_cost=1000, group_unknown=False)
    walked = lexicon.lexicon_ends(known, entries, spaces=" ", fold=partial(encoding.rolled, base=31, modulus=1000003), kind="bigint")
    rows = sentences(spark, sf_dir).select("doc_id", "i", walked(F.col("sentence")).alias("m"))
    return rows.select("doc_id", "i", "m.n", "m.cost", "m.ends")


@query(
    rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(text, '[{RE2_WORD}]+|[^{RE2_WORD}\s]') AS ws, list_slice(regexp_split_to_array(text, '[{RE2_WORD}]+|[^{RE2_WORD}\s]'), 1, -2) AS gaps FROM documents),
g AS (SELECT doc_id, unnest(ws) AS w, unnest(gaps) AS gap, unnest(range(len(ws))) AS pos FROM d),
o AS (SELECT doc_id, pos, length(w) AS n, sum(length(gap) + length(w)) OVER (PARTITION BY doc_id ORDER BY pos) - length(w) AS start FROM g),
p AS (SELECT doc_id, pos, k, start + 3 * k AS a, start + least(n, 3 * k + 3) AS b FROM (SELECT *, unnest(range((n + 2) // 3)) AS k FROM o))
SELECT doc_id, count(*) AS n, md5(string_agg(a::BIGINT || ':' || b::BIGINT, ',' ORDER BY pos, k)) AS offsets FROM p GROUP BY doc_id
"""
)
def aligned_offsets(spark, sf_dir):
    """Where lower-cased pieces of three characters stand in the whole texts that they come from."""
    piece = lambda w: F.transform(F.regexp_extract_all(F.lower(w), F.lit("(?s).{1,3}"), F.lit(0)), lambda p, k: F.when(k > 0, F.concat(F.lit("##"), p)).otherwise(p))
    # texts without a token go before they are analysed: a filter on the offsets would have them found twice
    rows = read(spark, sf_dir, "documents").where(F.col("text").rlike(analysis.PIECE))
    rows = rows.select("doc_id", "text", F.flatten(F.transform(analysis.regex_words(F.col("text")), piece)).alias("tokens"))
    rows = rows.select("doc_id", qa.token_offsets("text", "tokens").alias("o"))
    joined = F.array_join(F.transform("o", lambda o: F.concat_ws(":", o["start"], o["end"])), ",")
    return rows.select("doc_id", F.size("o").cast("long").alias("n"), F.md5(joined.cast("binary")).alias("offsets"))


_MODES = {"a": r"\p{Lu}?[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+|\p{Lu}+|\p{N}+|_|[^\p{L}\p{N}_\s]", "b": r"[\p{L}_]+|\p{N}+|[^\p{L}\p{N}_\s]", "c": r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"}


@query("WITH w AS (SELECT doc_id, " + ", ".join(f"regexp_extract_all(text, '{p}') AS {m}" for m, p in _MODES.items()) + " FROM documents) SELECT doc_id, " + ", ".join(f"len({m}) AS n_{m}, md5(array_to_string({m}, ' ')) AS {m}" for m in _MODES) + " FROM w")
def split_modes(spark, sf_dir):
    """Units of whole texts, short, middle and long."""
    rows = read(spark, sf_dir, "documents").select("doc_id", *[analysis.split_words(F.col("text"), analysis.split_mode(m)).alias(m) for m in _MODES])
    parts = [(F.size(m).cast("long").alias(f"n_{m}"), F.md5(F.array_join(m, " ").cast("binary")).alias(m)) for m in _MODES]
    return rows.select("doc_id", *[c for pair in parts for c in pair])


@query(f"WITH {SENTENCES}, {_MORPHEMES} SELECT CASE WHEN surface IN ('the', 'la') THEN 'ART' ELSE lower(surface) END AS form, CASE WHEN surface IN ('the', 'la') THEN '[article-common]' ELSE '[other]' END AS tag, count(*) AS n FROM m GROUP BY ALL")
def lexicon_forms(spark, sf_dir):
    """A small lexicon over the regular-expression analyzer."""
    entry = "named_struct('dictionary_form', 'ART', 'normalized_form', 'ART', 'reading_form', 'ART', 'pos', array('article', 'common', '*', '*', '*', '*'))"
    lexicon = F.expr(f"map('the', {entry}, 'la', {entry})")
    rows = surfaces(spark, sf_dir).select("freq", F.explode(analysis.lexicon_morphemes(lexicon)(F.col("word"))).alias("m"))
    tag = F.when(F.col("m.pos")[0] == "article", morphology.pos_tag(F.col("m.pos"))).otherwise("[other]")
    return rows.groupBy(F.col("m.normalized_form").alias("form"), tag.alias("tag")).agg(F.sum("freq").alias("n"))


_WORDS = rf"w AS (SELECT doc_id, regexp_extract_all(text, '[{RE2_WORD}]+|[^{RE2_WORD}\s]') AS ws FROM documents)"


@query(f"WITH {_WORDS} SELECT doc_id, md5(array_to_string(ws, ' ')) AS spaced, md5(array_to_string(list_transform(ws, lambda x: lower(x)), '|')) AS pretokens, md5(array_to_string(ws, '|')) AS slices FROM w")
def segmented(spark, sf_dir):
    """Space-separated texts, and pretokens: lower-cased ones, and slices of the text by the offsets."""
    rows = tokenizer.segment_columns(read(spark, sf_dir, "documents").select("doc_id", "text", F.col("text").alias("spaced")), ["spaced"], "spaced")
    digest = lambda c: F.md5(c.cast("binary"))
    lowered = analysis.words_in_form(analysis.regex_morphemes, "normalized", morphology.word_form("normalized"))(F.col("text"))
    forms = {"pretokens": lowered, "slices": morphology.slices(F.col("text"), analysis.offsets_of(F.col("text")))}
    return rows.select("doc_id", digest(F.col("spaced")).alias("spaced"), *[digest(F.array_join(c, "|")).alias(n) for n, c in forms.items()])


# -- documents --------------------------------------------------------------------

_CUT = r"""regexp_replace(regexp_replace({}, '([。！？!?]+)\s*', '\1' || chr(10), 'g'), '\.(\s+|$)', '.' || chr(10), 'g')"""


@query(f"WITH p AS (SELECT doc_id, list_filter(string_split({_CUT.format('text')}, chr(10)), lambda x: x <> '') AS parts FROM documents) SELECT doc_id, len(parts) AS n, md5(array_to_string(parts, '|')) AS digest FROM p")
def sentence_bounds(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select("doc_id", documents.split_sentences(F.col("text")).alias("parts"))
    return rows.select("doc_id", F.size("parts").cast("long").alias("n"), F.md5(F.array_join("parts", "|").cast("binary")).alias("digest"))


def marked_up(t: Column) -> Column:
    """A text as the one paragraph of an article, from its marker's line on; null where the text is."""
    return F.concat(F.lit(f"{documents.ARTICLE}\ntitle\n{documents.PARAGRAPH}\n"), F.replace(t, F.lit("\n"), F.lit(documents.NEWLINE)))


def plain_digest(plain: Column) -> Column:
    """md5 of an article's lines without markers: the first, which is blank and has its line break also where no other follows, and the others."""
    return F.md5(F.concat(F.get(plain, F.lit(0)), F.lit("\n"), F.array_join(F.slice(plain, F.lit(2), F.array_size(plain)), "\n")).cast("binary"))


@query(
    f"""WITH p AS (SELECT doc_id, list_filter(flatten(list_transform(string_split(text, chr(10)), lambda l: string_split({_CUT.format('l')}, chr(10)))), lambda x: x <> '') AS parts FROM documents)
SELECT doc_id, len(parts) + 2 AS n_raw, len(parts) + 1 AS n, md5(chr(10) || array_to_string(parts, chr(10))) AS digest FROM p"""
)
def article_corpus(spark, sf_dir):
    """Articles to the lines of a raw corpus, and these without markers."""
    rows = read(spark, sf_dir, "documents").select("doc_id", documents.article_lines(F.concat(F.lit("\n"), marked_up(F.col("text")))).alias("raw"))
    rows = rows.withColumn("plain", documents.strip_markers(F.col("raw")))
    return rows.select("doc_id", F.array_size("raw").cast("long").alias("n_raw"), F.array_size("plain").cast("long").alias("n"), plain_digest(F.col("plain")).alias("digest"))


@query(
    f"""WITH {SENTENCES}, {_MORPHEMES}, b AS (SELECT DISTINCT doc_id FROM m WHERE surface IN {LISTED}), k AS (SELECT doc_id, lang, count(*) FILTER (WHERE length(sentence) BETWEEN 10 AND 200) AS n FROM s GROUP BY doc_id, lang)
SELECT lang, count(*) AS n_docs, sum(n)::BIGINT AS n_sentences FROM k WHERE n >= 5 AND doc_id NOT IN (
  SELECT m.doc_id FROM m JOIN s ON s.doc_id = m.doc_id AND s.i = m.i WHERE surface IN {LISTED} AND length(sentence) BETWEEN 10 AND 200) GROUP BY lang"""
)
def clean_ng_words(spark, sf_dir):
    kept = documents.clean(docs(spark, sf_dir), sentence_filters=["sequence_length"], document_filters=["short_document", "ng_words"], ng_words=LISTED)
    return kept.groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.size("sentences")).alias("n_sentences"))


# -- encoding ---------------------------------------------------------------------


@query(
    f"""WITH {SENTENCES}, {_VOCAB}, x AS (SELECT doc_id, i, pos, CASE WHEN lower(surface) IN (SELECT token FROM v) THEN lower(surface) ELSE '[UNK]' END AS token FROM m)
SELECT doc_id, i::INT AS i, md5(string_agg(token, ' ' ORDER BY pos)) AS digest FROM x GROUP BY doc_id, i"""
)
def decode_ids(spark, sf_dir):
    """Ids back to tokens, and tokens to text."""
    known = vocab.lookup(vocabulary(spark, sf_dir))
    words = F.transform(analysis.regex_words(F.col("sentence")), F.lower)
    # a filter on the ids would have them looked up twice
    rows = sentences(spark, sf_dir).where(F.col("sentence").rlike(analysis.PIECE)).withColumn("ids", known.ids(words))
    return rows.select("doc_id", "i", F.md5(encoding.to_text(known.tokens(F.col("ids"))).cast("binary")).alias("digest"))


@query(f"WITH {SENTENCES}, {_VOCAB} SELECT id, token FROM v WHERE id < 120")
def character_vocabulary(spark, sf_dir):
    return vocab.first_ids(vocabulary(spark, sf_dir), 120)


ROOM = 40
_PAIRS = rf"""t AS (SELECT conv_id, turn, list_transform(regexp_extract_all(coalesce(text, ''), '[{RE2_WORD}]+|[^{RE2_WORD}\s]'), lambda x: lower(x)) AS ws FROM conversations),
p AS (SELECT x.conv_id, x.turn, x.ws AS a, y.ws AS b, len(x.ws) AS na, len(y.ws) AS nb FROM t x JOIN t y ON y.conv_id = x.conv_id AND y.turn = x.turn + 1)"""


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each turn and of the next."""
    words = F.transform(analysis.regex_words(F.coalesce("text", F.lit(""))), F.lower)
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("a"))
    return rows.join(rows.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("a").alias("b")), ["conv_id", "turn"])


@query(
    f"""WITH {_PAIRS} SELECT conv_id, turn, md5(array_to_string(list_concat(['[CLS]'], a, ['[SEP]'], b, ['[SEP]']), ' ')) AS tokens,
'1' || repeat('0', na::INT) || '1' || repeat('0', nb::INT) || '1' AS mask, repeat('0', na::INT + 2) || repeat('1', nb::INT + 1) AS types FROM p"""
)
def encode_pairs(spark, sf_dir):
    a, b = F.col("a"), F.col("b")
    return turn_pairs(spark, sf_dir).select(
        "conv_id",
        "turn",
        F.md5(F.array_join(encoding.with_specials(a, b), " ").cast("binary")).alias("tokens"),
        F.array_join(encoding.special_mask(a, b), "").alias("mask"),
        F.array_join(encoding.token_types(a, b), "").alias("types"),
    )


@query(
    f"""WITH RECURSIVE {_PAIRS}, c AS (SELECT conv_id, turn, na, nb FROM p UNION ALL SELECT conv_id, turn, CASE WHEN na > nb THEN na - 1 ELSE na END, CASE WHEN na > nb THEN nb ELSE nb - 1 END FROM c WHERE na + nb > {ROOM})
SELECT p.conv_id, p.turn, md5(array_to_string(list_slice(a, 1, c.na), ' ')) AS a, md5(array_to_string(list_slice(b, 1, c.nb), ' ')) AS b FROM p JOIN c ON c.conv_id = p.conv_id AND c.turn = p.turn WHERE c.na + c.nb <= {ROOM}"""
)
def fit_pairs(spark, sf_dir):
    """Pairs cut to a length, word by word from the longer."""
    a, b = tokenizer.fitting(F.col("a"), F.col("b"), ROOM)
    return turn_pairs(spark, sf_dir).select("conv_id", "turn", *[F.md5(F.array_join(c, " ").cast("binary")).alias(n) for c, n in ((a, "a"), (b, "b"))])


@query(
    f"""WITH {SENTENCES}, {_VOCAB}, x AS (SELECT doc_id, i, pos, coalesce(v.id, 1) AS id FROM m LEFT JOIN v ON v.token = lower(surface)),
e AS (SELECT doc_id, i, list(id ORDER BY pos)[1:22] AS ids FROM x GROUP BY ALL), a AS (SELECT s.doc_id, s.i, coalesce(ids, []) AS ids FROM s LEFT JOIN e ON e.doc_id = s.doc_id AND e.i = s.i)
SELECT doc_id, i::INT AS i, array_to_string(list_concat([2], ids, [3], list_transform(range(0, 22 - len(ids)), lambda z: 0)), ',') AS input_ids, (len(ids) + 2)::BIGINT AS attended FROM a"""
)
def tokenizer_ids(spark, sf_dir):
    """The whole tokenizer: words looked up by WordPiece, cut and padded to 24 ids."""
    rows = vocabulary(spark, sf_dir).orderBy("id").collect()
    found = tokenizer.Tokenizer([r.token for r in rows], word_form="normalized").encode(sentences(spark, sf_dir).select("doc_id", "i", "sentence"), "sentence", max_length=24, padded=True)
    return found.select("doc_id", "i", F.array_join("input_ids", ",").alias("input_ids"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).cast("long").alias("attended"))


@query(
    f"""WITH {_WORDS} SELECT doc_id, list_position(['de', 'en', 'es', 'fr'], lang)::BIGINT - 1 AS label_id,
  array_to_string([2] || list_transform(ws[1:14], lambda x: CASE lower(x) WHEN 'the' THEN 5 WHEN 'la' THEN 6 ELSE 1 END) || [3], ',') AS ids, least(len(ws), 14) + 2 AS n FROM documents JOIN w USING (doc_id)"""
)
def class_features(spark, sf_dir):
    known = tokenizer.Tokenizer([*vocab.SPECIALS, "the", "la"], word_form="normalized")
    rows = read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    found = tokenizer.classification_features(rows, known, ["text"], "lang", ["de", "en", "es", "fr"], max_length=16)
    return found.select("doc_id", F.col("label_id").cast("long").alias("label_id"), F.array_join("input_ids", ",").alias("ids"), F.size("input_ids").cast("long").alias("n"))


@query(
    rf"""WITH {_WORDS}, k AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS k FROM w)
SELECT doc_id, sum(CASE WHEN length(w) > 3 THEN 2 ELSE 1 END)::BIGINT AS n, sum(k * CASE WHEN length(w) > 3 THEN 2 ELSE 1 END)::BIGINT AS total FROM k GROUP BY doc_id"""
)
def subword_index(spark, sf_dir):
    """Each subword's word, where words of over three characters are cut in two."""
    two = lambda w: F.when(F.char_length(w) > 3, F.array(F.substring(w, 1, 3), F.concat(F.lit("##"), F.substring(w, F.lit(4), F.char_length(w))))).otherwise(F.array(w))
    rows = read(spark, sf_dir, "documents").select("doc_id", F.flatten(F.transform(analysis.regex_words(F.col("text")), two)).alias("t")).where(F.size("t") > 0)
    rows = rows.withColumn("k", encoding.word_index(F.col("t")))
    return rows.select("doc_id", F.size("k").cast("long").alias("n"), F.aggregate("k", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT item_id, len(regexp_extract_all(text, '^ *[^ ] *|[^ ] *')) AS n, md5(array_to_string(regexp_extract_all('  ' || text, '^ *[^ ] *|[^ ] *'), '|')) AS digest FROM benchmark")
def merge_spaces(spark, sf_dir):
    """Characters as tokens, white space glued to them."""
    chars = F.filter(F.split(F.concat(F.lit("  "), "text"), ""), lambda c: c != "")
    rows = read(spark, sf_dir, "benchmark").select("item_id", encoding.merge_space_tokens(chars).alias("t"))
    return rows.select("item_id", F.size("t").cast("long").alias("n"), F.md5(F.array_join("t", "|").cast("binary")).alias("digest"))


# -- evaluation data --------------------------------------------------------------


@query("SELECT c_custkey AS id, c_mktsegment AS label FROM customer")
def project_rename(spark, sf_dir):
    return datasets.select_columns(read(spark, sf_dir, "customer"), {"c_custkey": "id", "c_mktsegment": "label"})


@query("SELECT o_orderpriority AS sentence1, o_orderstatus AS label, count(*) AS n FROM orders GROUP BY ALL")
def convert_reviews(spark, sf_dir):
    rows = datasets.convert_reviews(read(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")
    return rows.groupBy("sentence1", "label").agg(F.count(F.lit(1)).alias("n"))


_NO_SPACE = r"regexp_replace({}, '[\x{{09}}-\x{{0D}}\x{{1C}}-\x{{20}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]', '', 'g')"


@query(f"SELECT p_partkey AS id, {_NO_SPACE.format('p_name')} AS context, {_NO_SPACE.format(chr(39) + ' ' + chr(39) + ' || p_type')} AS choice_0, {_NO_SPACE.format('p_brand')} AS choice_1, 'x' AS choice_2, '' AS choice_3, (p_size % 4)::INT AS label FROM part")
def convert_choices(spark, sf_dir):
    letter = F.substring(F.lit("abcd"), F.col("p_size") % 4 + 1, F.lit(1))
    rows = read(spark, sf_dir, "part").select(F.col("p_name").alias("context"), F.concat(F.lit(" "), "p_type").alias("choice_a"), F.col("p_brand").alias("choice_b"), F.lit("x").alias("choice_c"), F.lit("\t").alias("choice_d"), letter.alias("label"), "p_partkey")
    out = datasets.convert_choices(rows.withColumn("context", F.concat("context", F.lit(" #"), F.col("p_partkey").cast("string"))))
    return out.select(F.regexp_extract("context", "#([0-9]+)$", 1).cast("long").alias("id"), F.regexp_replace("context", "#[0-9]+$", "").alias("context"), *[f"choice_{i}" for i in range(4)], "label")


@query(f"SELECT doc_id, md5({_NO_SPACE.format('text')}) AS digest FROM documents")
def drop_spaces(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", F.md5(text.drop_spaces(F.col("text")).cast("binary")).alias("digest"))


@query("SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS place FROM customer")
def ordered_places(spark, sf_dir):
    """The shuffle without a seed: the key's own order."""
    return datasets.shuffled(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id", None)


@query()
def seeded_shuffle(spark, sf_dir):
    return datasets.shuffled(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id", 42)


@query("SELECT c_custkey AS id FROM customer ORDER BY c_custkey LIMIT 7")
def limit_rows(spark, sf_dir):
    return datasets.limit_rows(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), ["id"], 7)


@query(
    rf"""WITH b AS (SELECT item_id, regexp_extract_all(text, '[{RE2_WORD}]+|[^{RE2_WORD}\s]') AS ws FROM benchmark), a AS (SELECT *, substr(array_to_string(ws, ''), 6, 9) AS answer FROM b),
r AS (SELECT item_id, ws, answer, x.k AS k, y.size AS size FROM a, range(1, 200) x(k), range(1, 12) y(size) WHERE x.k + y.size - 1 <= len(ws)),
h AS (SELECT item_id, lower(array_to_string(ws[k:k + size - 1], '')) AS form FROM r WHERE contains(array_to_string(ws[k:k + size - 1], ''), answer) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY size, k) = 1)
SELECT item_id, form FROM h"""
)
def relocated_answers(spark, sf_dir):
    """Answers that a normalized context lacks, by the shortest run of words that holds them."""
    words = analysis.regex_words(F.col("text"))
    rows = read(spark, sf_dir, "benchmark").select("item_id", words.alias("w"), F.substring(F.array_join(words, ""), 6, 9).alias("answer"))
    form = datasets.relocated_answer(F.col("answer"), F.lit(""), F.lit("?"), F.col("w"), F.transform("w", F.lower))
    return rows.select("item_id", form.alias("form"))


_SOLID = r"list_filter(range(1, length(text) + 1), lambda k: NOT regexp_matches(text[k], '[\s\x{A0}]'))"


@query(
    f"""WITH b AS (SELECT item_id, text, {_NO_SPACE.format('text')} AS bare, {_SOLID} AS solid FROM benchmark), a AS (SELECT *, substr(bare, 11, 20) AS answer, strpos(bare, substr(bare, 11, 20)) AS k FROM b)
SELECT item_id, (solid[k] - 1)::INT AS start, solid[k + length(answer) - 1]::INT AS stop FROM a"""
)
def spaced_spans(spark, sf_dir):
    answer = F.substring(text.drop_spaces(F.col("text")), 11, 20)
    spaced = F.array_join(F.split(answer, ""), " ")
    rows = read(spark, sf_dir, "benchmark").select("item_id", datasets.spaced_span(F.col("text"), spaced).alias("s"))
    return rows.select("item_id", F.col("s.start").alias("start"), F.col("s.end").alias("stop"))


@query(
    f"""WITH {SENTENCES.replace("string_split(text, chr(10))", "[text]")}, {_SPANS}, n AS (SELECT doc_id, count(*) AS n FROM o GROUP BY doc_id), f AS (SELECT doc_id, n, unnest(range(0, greatest(ceil((n - 59) / 39.0), 0)::INT + 1)) AS k FROM n),
c AS (SELECT f.doc_id, k, count(*) FILTER (WHERE stop - length(w) <= 40) - 1 AS a, count(*) FILTER (WHERE stop < 60) AS b, min(stop - length(w)) AS first, max(stop) AS last FROM f JOIN o ON o.doc_id = f.doc_id AND pos >= k * 39 AND pos < k * 39 + 59 GROUP BY f.doc_id, k)
SELECT doc_id, k::INT AS feature_idx, CASE WHEN 40 >= first AND 60 <= last THEN a + 3 ELSE 0 END AS start_position, CASE WHEN 40 >= first AND 60 <= last THEN b + 3 ELSE 0 END AS end_position FROM c"""
)
def span_labels(spark, sf_dir):
    """Characters 40 to 60 of every text as the answer: its first and last token in each overlapping chunk."""
    found = analysis.offsets_of(F.col("text"))
    # a filter on the offsets would have them found twice
    rows = read(spark, sf_dir, "documents").where(F.col("text").rlike(analysis.PIECE))
    rows = rows.select("doc_id", F.array(F.lit("what"), F.lit("?")).alias("q"), found.alias("o"))
    out = qa.overflow_features(rows, "q", "o", "o", length=64, stride=20)
    label = qa.span_labels(F.col("chunk_offsets"), F.lit(40), F.lit(60), shift=3)
    return out.select("doc_id", "feature_idx", label["start_position"].cast("long").alias("start_position"), label["end_position"].cast("long").alias("end_position"))


@query(
    """WITH b AS (SELECT c_custkey AS id, (row_number() OVER (ORDER BY c_custkey) - 1) // 16 AS batch, c_custkey % 9 + 1 AS n FROM customer), c AS (SELECT *, max(n) OVER (PARTITION BY batch) AS most, count(*) OVER (PARTITION BY batch) AS size FROM b)
SELECT id, batch, repeat('7', n::INT) || repeat('0', (most - n)::INT) AS ids FROM c WHERE size = 16"""
)
def padded_batches(spark, sf_dir):
    """Batches of 16, the remainder dropped, padded to their longest row."""
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.array_repeat(F.lit(7), (F.col("c_custkey") % 9 + 1).cast("int")).alias("ids"))
    return datasets.padded_batches(rows, "id", "ids", 16, drop_remainder=True).withColumn("ids", F.array_join("ids", ""))


_PLAIN = r"list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower({}), '[!-/:-@\[-`{{-~]', '', 'g'), '\b(a|an|the)\b', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '')"


@query(
    f"""WITH d AS (SELECT p_partkey AS id, {_PLAIN.format("'The ' || p_name || '!'")} AS a, {_PLAIN.format("CASE WHEN p_size % 2 = 0 THEN p_name ELSE 'a red ' || p_name || ' red' END")} AS b FROM part),
w AS (SELECT id, 'a' AS k, unnest(a) AS x FROM d UNION ALL SELECT id, 'b', unnest(b) FROM d), m AS (SELECT id, x, count(*) FILTER (WHERE k = 'a') AS p, count(*) FILTER (WHERE k = 'b') AS q FROM w GROUP BY ALL), f AS (SELECT id, sum(least(p, q)) AS same FROM m GROUP BY id)
SELECT id, (a = b)::INT AS exact, round(CASE WHEN same = 0 THEN 0.0 ELSE 2.0 * same / (len(a) + len(b)) END, 9)::DOUBLE AS f1 FROM d JOIN f USING (id)"""
)
def answer_match(spark, sf_dir):
    """Exact match and F1 of words, without case, punctuation and articles."""
    gold, guess = F.concat(F.lit("The "), "p_name", F.lit("!")), F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.lit("a red "), "p_name", F.lit(" red")))
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), metrics.exact_match(gold, guess).alias("exact"), F.round(metrics.overlap_f1(gold, guess), 9).alias("f1"))


# -- files: written to the shared folder, and read back ------------------------------


def folder(spark: SparkSession) -> str:
    return f"{checkpoint_dir(spark)}/lexiloom/files-{uuid.uuid4().hex}"


_STRIPPED = r"list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '\A[\s\x{A0}]+|[\s\x{A0}]+\z', '', 'g')), lambda x: x <> '')"


def stripped_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.filter(F.transform(F.split("text", "\n"), lambda x: text.strip(x)), lambda x: x != "")
    return read(spark, sf_dir, "documents").select("doc_id", lines.alias("sentences")).where(F.size("sentences") > 0)


@query(f"SELECT md5(array_to_string({_STRIPPED}, chr(10))) AS digest, len({_STRIPPED}) AS n, count(*) AS docs FROM documents WHERE len({_STRIPPED}) > 0 GROUP BY ALL")
def corpus_files(spark, sf_dir):
    path = folder(spark)
    sinks.write_corpus(stripped_docs(spark, sf_dir), path, ["doc_id"])
    rows = readers.blank_line_documents(spark, path)
    return rows.groupBy(F.md5(F.array_join("sentences", "\n").cast("binary")).alias("digest"), F.size("sentences").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("docs"))


@query(SQL["corpus_files"])
def corpus_ranges(spark, sf_dir):
    """corpus_files with part files read in byte ranges, several a file."""
    path = folder(spark)
    sinks.write_corpus(stripped_docs(spark, sf_dir), path, ["doc_id"])
    rows = corpus.read_corpus(spark, path, split_bytes=1 << 17)
    return rows.groupBy(F.md5(F.array_join("sentences", "\n").cast("binary")).alias("digest"), F.size("sentences").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("docs"))


@query(
    f"""
WITH RECURSIVE d AS (SELECT doc_id, len({_STRIPPED}) AS n FROM documents), e AS (SELECT doc_id, sum(n + 1) OVER (ORDER BY doc_id) AS stop FROM d WHERE n > 0),
cuts AS (SELECT 0::HUGEINT AS cut UNION ALL SELECT (SELECT min(stop) FROM e WHERE stop - cut > 1000) FROM cuts WHERE (SELECT min(stop) FROM e WHERE stop - cut > 1000) IS NOT NULL)
SELECT shard_id, count(*) AS docs FROM (SELECT (SELECT count(*) FROM cuts WHERE cut < stop) AS shard_id FROM e) GROUP BY shard_id
"""
)
def shard_files(spark, sf_dir):
    path = folder(spark)
    sinks.write_shards(documents.shard_ids(stripped_docs(spark, sf_dir), "doc_id", 1000), path, ["doc_id"])
    rows = readers.blank_line_documents(spark, f"{path}/*")
    return rows.groupBy(F.regexp_extract("path", "shard_id=([0-9]+)", 1).cast("long").alias("shard_id")).agg(F.count(F.lit(1)).alias("docs"))


@query(f"WITH {SENTENCES}, {_VOCAB} SELECT token, max(id) AS id FROM v GROUP BY token")
def vocabulary_files(spark, sf_dir):
    path = folder(spark)
    sinks.write_vocabulary(vocabulary(spark, sf_dir), path)
    return readers.vocabulary(spark, f"{path}/part-*").select("token", F.col("id").cast("int").alias("id"))


@query(SQL["split_ratio"])
def split_files(spark, sf_dir):
    path = folder(spark)
    sinks.write_splits(split_ratio(spark, sf_dir), path, "json")
    return readers.json_splits(spark, path, "id long", {s: f"split={s}" for s in ("train", "dev", "test")})


_QUOTED = "CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 11 = 0 THEN NULL ELSE concat(chr(34), text, chr(44), chr(34), chr(92), chr(34), chr(10)) END"


@query(f"SELECT CASE WHEN doc_id % 10 < 8 THEN 'train' WHEN doc_id % 10 = 8 THEN 'validation' ELSE 'test' END AS split, doc_id::VARCHAR AS doc_id, md5({_QUOTED}) AS digest FROM documents")
def evaluation_files(spark, sf_dir):
    """Whole texts with quotes, separators, backslashes and line breaks, empty ones and nulls, written as splits and read again."""
    path, rows = folder(spark), read(spark, sf_dir, "documents")
    part = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "dev").otherwise("test")
    quoted = F.when(F.col("doc_id") % 7 == 0, "").when(F.col("doc_id") % 11 == 0, None).otherwise(F.concat(F.lit('"'), "text", F.lit(',"\\"\n')))
    sinks.write_splits(rows.select("doc_id", quoted.alias("text"), part.alias("split")), path, "csv")
    found = [df.select(F.lit(s).alias("split"), "doc_id", F.md5(F.col("text").cast("binary")).alias("digest")) for s, df in readers.evaluation_splits(spark, path).items()]
    return found[0].union(found[1]).union(found[2])


@query(f"WITH {_PREDICTED} SELECT stage AS setting, round(avg((label = prediction)::DOUBLE), 9) AS accuracy, max(round(label / 2.0, 3))::DOUBLE AS exact FROM p GROUP BY stage")
def prediction_files(spark, sf_dir):
    """Logs with labels in place of ids, and metrics, a directory a setting."""
    path, rows = folder(spark), materialize(predictions(spark, sf_dir), "predictions")
    for setting in ("Dev", "Test"):
        own = rows.where(F.col("stage") == setting).select(F.col("doc_id").alias("index"), "label", "prediction")
        sinks.write_predictions(own, f"{path}/{setting}/dev_predictions.tsv", ["index"], labels=["bad", "good"])
        own.agg(F.max(F.round(F.col("label") / 2, 3)).alias("exact"), F.lit(0.0).alias("f1")).coalesce(1).write.json(f"{path}/{setting}/dev_metrics.json")
    logs = readers.prediction_logs(spark, path, "dev").groupBy("setting").agg(F.round(metrics.accuracy(F.col("label"), F.col("prediction")), 9).alias("accuracy"))
    return logs.join(readers.metric_files(spark, path, "dev").select("setting", "exact"), "setting")


def written(t: Column) -> Column:
    """A text as a file holds it: an article without a paragraph where it is null."""
    return F.coalesce(marked_up(t), F.lit(f"{documents.ARTICLE}\ntitle"))


def digests_of_read(articles: DataFrame) -> DataFrame:
    """(digest, n) of articles that were written(); the line break is given back that readers take from the end, so that an empty paragraph is one."""
    raw = articles.select(documents.article_lines(F.concat("article", F.lit("\n"))).alias("raw"))
    rows = raw.withColumn("plain", F.when(F.array_contains("raw", documents.PARAGRAPH), documents.strip_markers(F.col("raw"))))
    return rows.groupBy(plain_digest(F.col("plain")).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query(
    f"""WITH p AS (SELECT list_filter(flatten(list_transform(string_split(text, chr(10)), lambda l: string_split({_CUT.format('l')}, chr(10)))), lambda x: x <> '') AS parts FROM documents)
SELECT md5(chr(10) || array_to_string(parts, chr(10))) AS digest, count(*) AS n FROM p GROUP BY 1"""
)
def article_files(spark, sf_dir):
    """Marked-up articles written, read, cut into sentences and stripped of their markers."""
    path = folder(spark)
    sinks.write_articles(read(spark, sf_dir, "documents").select(written(F.col("text")).alias("value")), path)
    return digests_of_read(readers.articles(spark, path))


@query(SQL["article_files"])
def article_ranges(spark, sf_dir):
    """article_files read in byte ranges, several a file."""
    path = folder(spark)
    read(spark, sf_dir, "documents").select(written(F.col("text")).alias("value")).write.text(path)
    return digests_of_read(corpus.read_corpus(spark, path, "articles", split_bytes=1 << 17))


@query("SELECT source AS word, count(*) AS n FROM documents WHERE doc_id % 7 <> 0 AND source IS NOT NULL GROUP BY source")
def word_list_files(spark, sf_dir):
    """Names on lines with white space after them, blank lines between, written and read."""
    path = folder(spark)
    ends = F.element_at(F.array(*map(F.lit, ("\t ", "　", "", " "))), (F.col("doc_id") % 4 + 1).cast("int"))
    line = F.when(F.col("doc_id") % 7 == 0, ends).otherwise(F.concat("source", ends))
    read(spark, sf_dir, "documents").select(F.coalesce(line, F.lit("")).alias("value")).write.text(path)
    return readers.word_list(spark, path).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand AS class, p_type AS key, string_agg(p_size || '>' || p_brand, ',' ORDER BY p_size) AS rules FROM (SELECT DISTINCT p_brand, p_type, p_size FROM part) GROUP BY p_brand, p_type")
def rule_files(spark, sf_dir):
    """A nested table of rules, by brand and type, written as one JSON document and read."""
    path = folder(spark)
    inner = read(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.array_sort(F.collect_set("p_size")).alias("sizes"))
    inner = inner.select("p_brand", F.struct(F.col("p_type"), F.transform("sizes", lambda n: F.array(n.cast("string"), F.col("p_brand"))).alias("rules")).alias("e"))
    outer = inner.groupBy("p_brand").agg(F.map_from_entries(F.collect_list("e")).alias("rules"))
    one = outer.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("p_brand", "rules")))).alias("value"))  # a rule table is as large as its classes and keys
    one.coalesce(1).write.text(path)
    rows = readers.rule_table(spark, f"{path}/part-*", "array<array<string>>").where("class IS NOT NULL")
    return rows.select("class", "key", F.array_join(F.transform("value", lambda r: F.concat_ws(">", r)), ",").alias("rules"))


@query(SQL["qa_nbest"])
def answer_files(spark, sf_dir):
    """Chosen answers written and read back."""
    path = folder(spark)
    sinks.write_answers(nbest(spark, sf_dir), path)
    rows = spark.read.schema("id long, prediction string").json(f"{path}/predictions")
    return rows.select("id", token_range(F.col("prediction")).alias("chosen"))


# -- normalization of whole columns ---------------------------------------------------


@query("SELECT c_custkey AS id, lower(c_name) AS name, lower(c_name) AS stripped FROM customer")
def normalize_columns(spark, sf_dir):
    """Word forms of a column of names, and the input normalizer on decorated ones."""
    dirty = text.input_normalizer(do_strip=True, do_lower_case=True, do_nfkc=True)(F.concat(F.lit("\t　"), "c_name", F.lit(" \n")))
    rows = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), dirty.alias("stripped"))
    return tokenizer.normalize_columns(rows, ["name"], "normalized")


@query(
    rf"""
WITH {SENTENCES}, n AS (SELECT doc_id, i::INT AS i, regexp_replace(concat('[12]', chr(9), sentence, '[a] b?]', chr(160)), '\[\p{{Nd}}+?\]|\[要.+?\]|\{{\{{+[^{{}}]+?\}}\}}+|\[(要出典|リンク切れ|.+?\?)\]', '', 'g') AS x FROM s)
SELECT doc_id, i, md5(regexp_replace(regexp_replace(x, '{RE2_UNPRINTABLE}', '', 'g'), ' +', ' ', 'g')) AS digest FROM n
"""
)
def norm_sequence(spark, sf_dir):
    """Two normalizers by name, in the order given."""
    dirty = F.concat(F.lit("[12]\t"), "sentence", F.lit("[a] b?]\u00a0"))
    both = text.sentence_normalizer(["citation", "whitespace"])
    return sentences(spark, sf_dir).select("doc_id", "i", F.md5(both(dirty).cast("binary")).alias("digest"))


_IDS = rf"list_transform(regexp_extract_all(COLUMN, '[{RE2_WORD}]+|[^{RE2_WORD}\s]'), lambda x: CASE x WHEN 'red' THEN 5 WHEN 'small' THEN 6 ELSE 1 END)"


@query(
    f"""WITH w AS (SELECT p_partkey AS id, {_IDS.replace('COLUMN', 'p_name')} AS a, {_IDS.replace('COLUMN', 'p_brand')} AS b, {_IDS.replace('COLUMN', 'p_type')} AS c FROM part)
SELECT id, array_to_string([2] || a || [3] || b || [3], ',') AS ids_0, array_to_string([2] || a || [3] || c || [3], ',') AS ids_1,
  repeat('0', len(a) + 2) || repeat('1', len(c) + 1) AS types_1 FROM w"""
)
def choice_features(spark, sf_dir):
    """Two choices a question, each encoded with its context."""
    known = tokenizer.Tokenizer([*vocab.SPECIALS, "red", "small"])
    rows = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("context"), F.col("p_brand").alias("choice_0"), F.col("p_type").alias("choice_1"))
    out = tokenizer.choice_features(rows, known, ["id"], ["choice_0", "choice_1"], max_length=64)
    ids = [F.array_join(F.col("input_ids")[i], ",").alias(f"ids_{i}") for i in range(2)]
    return out.select("id", *ids, F.array_join(F.col("token_type_ids")[1], "").alias("types_1"))


#: Sequences of the masked examples: their length, and what they ask for at most.
MASKED = {"max_length": 64, "most": 8, "dupes": 2}
_ROOM = MASKED["max_length"] - 2
_PIECES = "flatten(list_transform(ws, lambda w: list_transform(regexp_extract_all(lower(w), '(?s).{1,3}'), lambda p, k: CASE WHEN k > 1 THEN '##' || p ELSE p END)))"


@query(
    f"""
WITH RECURSIVE {SENTENCES}, {_VOCAB}, ids AS (SELECT token, max(id) AS id FROM v GROUP BY token), n_ids AS (SELECT max(id) + 1 AS n_ids FROM v),
p AS (SELECT doc_id, i, {_PIECES} AS ts FROM (SELECT *, regexp_extract_all(sentence, '[{RE2_WORD}]+|[^{RE2_WORD}\\s]') AS ws FROM s)),
placed AS (
  SELECT doc_id, i, len(ts) AS n, 0::BIGINT AS c, 0::BIGINT AS f FROM p WHERE i = 0
  UNION ALL
  SELECT doc_id, i, n, CASE WHEN f > 0 AND f + n > {_ROOM} THEN c + 1 ELSE c END, CASE WHEN f > 0 AND f + n > {_ROOM} THEN 0 ELSE f END FROM (
    SELECT p.doc_id, p.i, len(p.ts) AS n, CASE WHEN o.n = 0 THEN o.c ELSE o.c + (o.f + o.n - 1) // {_ROOM} END AS c, CASE WHEN o.n = 0 THEN o.f ELSE (o.f + o.n - 1) % {_ROOM} + 1 END AS f
    FROM placed o JOIN p ON p.doc_id = o.doc_id AND p.i = o.i + 1)
),
tok AS (SELECT doc_id, c + (f + j) // {_ROOM} AS q, (f + j) % {_ROOM} AS pos, token FROM (
  SELECT p.doc_id, c, f, unnest(ts) AS token, unnest(range(len(ts))) AS j FROM p JOIN placed ON p.doc_id = placed.doc_id AND p.i = placed.i)),
grouped AS (SELECT *, sum(CASE WHEN pos = 0 OR NOT starts_with(token, '##') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, q ORDER BY pos) - 1 AS k FROM tok),
own_ids AS (SELECT doc_id, q, list(coalesce(id, 1) ORDER BY pos) AS ids FROM tok LEFT JOIN ids USING (token) GROUP BY doc_id, q),
g AS (SELECT doc_id, q, k, list(pos ORDER BY pos) AS places FROM grouped GROUP BY doc_id, q, k),
drawn AS (
  SELECT doc_id, q, dupe, list({{'n': len(places)::BIGINT, 'places': places}} ORDER BY md5('12345:' || doc_id || ':' || dupe || ':' || q || ':word:' || k), places[1]) AS groups
  FROM g CROSS JOIN (SELECT unnest(range({MASKED["dupes"]})) AS dupe) GROUP BY doc_id, q, dupe
),
wanted AS (SELECT *, least({MASKED["most"]}, greatest(1, floor((len(ids) + 2) * 0.15::DOUBLE + 0.5)))::BIGINT AS most FROM drawn JOIN own_ids USING (doc_id, q)),
chosen AS (
  SELECT doc_id, q, dupe, ids, list_sort(list_reduce([{{'n': 0::BIGINT, 'places': []::BIGINT[]}}] || groups,
    lambda a, b: CASE WHEN a.n + b.n <= most THEN {{'n': a.n + b.n, 'places': list_concat(a.places, b.places)}} ELSE a END).places) AS places FROM wanted
),
shown AS (
  SELECT *, list_transform(ids, lambda x, k: CASE WHEN NOT list_contains(places, k - 1) THEN x
    WHEN ('0x' || substr(md5('12345:' || doc_id || ':' || dupe || ':' || q || ':token:' || (k - 1)), 1, 8))::BIGINT % 10 < 8 THEN 4
    WHEN ('0x' || substr(md5('12345:' || doc_id || ':' || dupe || ':' || q || ':token:' || (k - 1)), 1, 8))::BIGINT % 10 = 8 THEN x
    ELSE (('0x' || substr(md5('12345:' || doc_id || ':' || dupe || ':' || q || ':token:' || (k - 1)), 9, 8))::BIGINT % n_ids)::INT END) AS inputs FROM chosen, n_ids
)
SELECT doc_id, dupe::INT AS dupe, q::INT AS sequence_idx, '2,' || list_aggregate(inputs, 'string_agg', ',') || ',3' AS input_ids,
  coalesce(list_aggregate(list_transform(places, lambda p: p + 1), 'string_agg', ','), '') AS masked_positions, coalesce(list_aggregate(list_transform(places, lambda p: ids[p + 1]), 'string_agg', ','), '') AS masked_ids
FROM shown
"""
)
def masked_examples(spark, sf_dir):
    """Every document's sequences, masked twice; words stand in pieces of three characters, so that most have continuations."""
    known = vocab.lookup(vocabulary(spark, sf_dir))

    def pieces(word: Column) -> Column:
        return F.transform(F.regexp_extract_all(F.lower(word), F.lit("(?s).{1,3}"), F.lit(0)), lambda p, k: F.when(k > 0, F.concat(F.lit("##"), p)).otherwise(p))

    tokens = F.transform("sentences", lambda s: F.flatten(F.transform(analysis.regex_words(s), pieces)))
    rows = pretraining.masked_examples(docs(spark, sf_dir).select("doc_id", tokens.alias("tokens")), "doc_id", known, **MASKED)
    joined = lambda c: F.array_join(c, ",").alias(c)
    return rows.select("doc_id", "dupe", "sequence_idx", *map(joined, ("input_ids", "masked_positions", "masked_ids")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
