"""What no language of the labels explains is rejected, whatever its label says; every label has a class."""

import numpy as np
from graphlens.llm import language_id
from graphlens.llm.common import table

COLUMNS = "doc_id long, text string, lang string, source string"
FOREIGN = [
    "De regering heeft gisteren besloten dat de nieuwe wet niet eerder dan volgend jaar zal worden ingevoerd omdat er nog veel vragen zijn.",
    "Hallitus päätti eilen, että uusi laki ei tule voimaan ennen ensi vuotta, koska sen toimeenpanosta on vielä paljon kysymyksiä.",
    "Правительство решило вчера, что новый закон не вступит в силу раньше следующего года.",
    "deadbeef 9fa8c3d2e1 0x7ffeabcd 3fa9b8c7d6e5 cafebabe 12ab34cd 56ef7890 a1b2c3d4e5f6",
    "xqzj wkvp qzxj bvkw jqxz pwvk zzqx kjvb wqpx vxzk",
    "== 77 q 1234 ==",
]
SHORT = [("A.", "en"), ("Von.", "de"), ("That it.", "en"), ("un.", "fr"), ("Der eingeä erer.", "de"), ("Osrañ. que de la", "es")]


def test_unknown_languages_and_noise_are_rejected(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text", "lang", "source")
    more = [(-1 - k, t, "en", "src0") for k, t in enumerate(FOREIGN)] + [(-100 - k, t, lang, "src0") for k, (t, lang) in enumerate(SHORT)]
    docs = docs.unionByName(spark.createDataFrame(more, COLUMNS))
    got = {r.doc_id: r for r in language_id.identify_documents(docs, language_id.train(docs)).collect()}
    assert not any(got[-1 - k].accepted for k in range(len(FOREIGN)))
    assert all(got[-100 - k].accepted and got[-100 - k].lang == lang for k, (_, lang) in enumerate(SHORT))
    assert np.mean([r.accepted for r in got.values() if r.doc_id >= 0]) > 0.99


def test_every_label_has_a_class(spark):
    rng = np.random.default_rng(2)
    words = {f"l{k:02d}": ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(8)] for k in range(40)}
    rows = [(9 * i + j, " ".join(rng.choice(w, 30)), lang, None) for i, (lang, w) in enumerate(words.items()) for j in range(3)]
    docs = spark.createDataFrame(rows, COLUMNS)
    model = language_id.train(docs)
    assert model.languages == sorted(words)
    want = {r[0]: r[2] for r in rows}
    assert all(r.accepted and r.lang == r.text_lang == want[r.doc_id] for r in language_id.identify_documents(docs, model).collect())
