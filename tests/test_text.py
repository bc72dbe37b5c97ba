import hashlib
import uuid

from pyspark.sql import functions as F

from lexmill import constants as C
from lexmill.functions import keys, text
from lexmill.operators import chunking, ingest


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "v STRING").select(expr(F.col("v")).alias("r")).first()["r"]


def test_clean_html_decodes_common_and_rare_entities(spark):
    assert one(spark, "<b>a &amp; b</b>&nbsp;&eacute;&#8217;", text.clean_html) == "a & b é’"
    assert one(spark, "<p></p>", text.clean_html) is None
    assert one(spark, "&amp;lt;x", text.clean_html) == "&lt;x"


def test_a_reference_without_semicolon_is_text(spark):
    """As the SQL has it: a page cut inside ``&amp`` keeps what is left, beside rare references that are whole."""
    assert one(spark, "a &amp</p> b", text.clean_html) == "a &amp b"
    assert one(spark, "a &ampx; &am &#39 &eacute; &amp;#65; &copy b", text.clean_html) == "a &ampx; &am &#39 é &#65; &copy b"
    assert one(spark, "x &amp</p>\n\ny", text.normalize_body) == "x &amp \ny"


def test_unicode_words_stay_whole(spark):
    assert one(spark, "Été à Noël_2", text.word_tokens) == ["été", "à", "noël_2"]
    assert one(spark, " a b\x1cc ", text.split_words) == ["a", "b", "c"]


def test_noise_needs_whole_words(spark):
    assert one(spark, "Wholesale Distribution Deal", text.noise_hits) == ["deal"]
    assert one(spark, "buy this bundle at a discount price", text.noise_hits) == ["bundle", "buy", "discount", "price"]


def test_temporal(spark):
    assert one(spark, "Patch notes", text.is_temporal) is True
    assert one(spark, "in 2022", text.is_temporal) is False
    assert one(spark, "in 2023.", text.is_temporal) is True
    assert one(spark, "12023", text.is_temporal) is False


def test_uuid5_equals_python(spark):
    for name in ["elden-ring-2022", "été", ""]:
        want = str(uuid.uuid5(uuid.UUID(C.ENTITY_NAMESPACE), name))
        assert one(spark, name, lambda v: keys.uuid5(v, C.ENTITY_NAMESPACE)) == want


def test_chunk_uuid_is_two_steps(spark):
    inner = str(uuid.uuid5(uuid.UUID(C.ENTITY_NAMESPACE), hashlib.sha1(b"body").hexdigest()))
    assert one(spark, "body", keys.chunk_uuid) == str(uuid.uuid5(uuid.UUID(C.CHUNK_NAMESPACE), inner))


def test_slug(spark):
    assert one(spark, "Resident Evil 4 (2023)", keys.slug) == "resident-evil-4"
    assert one(spark, "Tom Clancy's Rainbow Six Siege", keys.slug) == "tom-clancy-s-rainbow-six-siege"
    assert one(spark, "A (2023)", lambda v: keys.entity_id(v, keys.title_year(v))) == "a-2023"


def chunk(spark, body, title, size, overlap):
    df = spark.createDataFrame([(1, body, title)], "id INT, body STRING, title STRING")
    return chunking.chunk_words(df, "body", "title", ["id"], size, overlap).orderBy("chunk_index").collect()


def test_tail_chunk_is_emitted(spark):
    rows = chunk(spark, " ".join(f"w{i}" for i in range(25)), None, 10, 2)
    assert [r["content"].split()[0] for r in rows] == ["w0", "w8", "w16", "w24"]
    assert len(chunk(spark, " ".join("x" for _ in range(20)), None, 5, 0)) == 4


def test_chunk_title_and_giant_word(spark):
    rows = chunk(spark, "<p>hello&nbsp;world</p>", "T", 10, 2)
    assert rows[0]["content"] == "T\n\nhello world"
    assert len(chunk(spark, "x" * 5000, None, 10, 2)[0]["content"]) == C.GIANT_WORD
    assert chunk(spark, "", "T", 10, 2) == []


def test_drop_reasons(spark):
    long = "a sentence of sufficient length to be kept as it is"
    assert one(spark, long, chunking.drop_reason) is None
    assert one(spark, long + " <b>", chunking.drop_reason) == "html"
    assert one(spark, "word " * 1001, chunking.drop_reason) == "oversized"
    assert one(spark, "$$$$ " + long, chunking.drop_reason) == "price_density"
    assert one(spark, "short\nlines\n", chunking.drop_reason) == "list_like"
    assert one(spark, "", chunking.drop_reason) == "list_like"


def test_equal_text_goes_to_the_smallest_owner(spark):
    body = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(i, body, "en", "s", 1) for i in (5, 3, 9)], "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT")
    assert [r["doc_id"] for r in chunking.build_chunks(df).collect()] == [3]


def test_sections(spark):
    body = "Lead.\n== Gameplay ==\nFun.\n=== See also ===\nLinks\n== Empty ==\n"
    df = spark.createDataFrame([(1, body)], "id INT, body STRING")
    rows = chunking.split_sections(df, "body", ["id"]).orderBy("idx").collect()
    assert [(r["title"], r["body"]) for r in rows] == [("Overview", "Lead."), ("Gameplay", "Fun.")]


def test_standard_date(spark):
    got = [one(spark, v, ingest.standard_date) for v in ("2018-03-27", "2018-03-27T12:00:00", "2018-03-27T12:00:00Z", "2018-3-27", "2018-13-01", "", "junk", None)]
    assert [str(g) if g else None for g in got] == ["2018-03-27"] * 3 + [None] * 5


def test_prune_fields(spark):
    df = spark.createDataFrame([(1, (("x", 2), [("a", "b")]))], "id INT, page STRUCT<logo: STRUCT<u: STRING, n: INT>, items: ARRAY<STRUCT<Icon: STRING, alt: STRING>>>")
    assert ingest.prune_fields(df).schema.simpleString() == "struct<id:int,page:struct<items:array<struct<alt:string>>>>"


def test_distinct_keeps_first_spelling_and_order(spark):
    from lexmill.operators.ingest import distinct_ci

    rows = spark.createDataFrame([(["b", "A", "a", "B", "c", "b"],), ([],)], "v ARRAY<STRING>")
    assert [r[0] for r in rows.select(distinct_ci(F.col("v"))).collect()] == [["b", "A", "c"], []]


def test_media_fields_of_all_sources_go(spark):
    from lexmill.operators.ingest import prune_fields

    names = ["id", "avatarUrl", "artworks", "my_artworks", "Poster", "videoList", "cover_id"]
    assert prune_fields(spark.createDataFrame([tuple("x" * len(names))], names)).columns == ["id", "my_artworks"]
