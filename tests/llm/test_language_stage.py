"""The language stage decides by the network: junk goes, clean documents of every language stay."""

import zlib

import corpus_pipeline
from cairn.llm import langid
from cairn.llm.common import table

SF = "/root/testdata/sf0.01"
JUNK = [
    "qxzv kjwq zzxk vbqj wkxq jzvq pqxz kvjw qzxv jkwz xqvk", "#$%^ 12 *** a ---- ||| 99 ~~~ $$$ ;;; ### @@@ !!! <<>>",
    "съешь же ещё этих мягких французских булок да выпей чаю", "日本語の文章はここに書かれています", "xkcdqwpzjvhgfbnmtrls" * 5,
]


def test_junk_goes(spark):
    docs = table(spark, SF, "documents")
    junk = docs.limit(0).unionByName(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(JUNK)], "doc_id long, text string, lang string"), allowMissingColumns=True)
    rows = docs.unionByName(junk)
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, rows, SF).collect()}
    assert not [i for i in kept if i < 0]
    clean = [r for r in docs.collect() if any(c.isalpha() for c in r["text"] or "")]
    held = [r for r in clean if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]  # the network never saw these
    for some in (clean, held):
        for lang in {r["lang"] for r in some if r["lang"]}:
            of = [r["doc_id"] in kept for r in some if r["lang"] == lang]
            assert sum(of) >= 0.99 * len(of)


def test_few_labels_reject_nothing(spark):
    few = spark.createDataFrame([(1, JUNK[0], "en"), (2, "12 34", None), (3, None, None)], "doc_id long, text string, lang string")
    assert [r["doc_id"] for r in langid.keep_identified(few).collect()] == [1]
