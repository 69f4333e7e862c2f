import numpy as np
from pyspark.sql import functions as F

from inkwell.llm import cotrain, language_id
from inkwell.llm.language_id import accepted, fit, fold, identify


def test_held_out_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = fit(docs.filter(fold() != 1))
    got = identify(docs, model).join(docs.select("doc_id", "lang", fold().alias("fold")), "doc_id").filter("fold = 1")
    assert got.filter("lang = lang_pred").count() >= 0.98 * got.count() > 0
    assert got.filter("rejected or score < 0 or score > 1").count() == 0
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "Привет, как дела? " * 20, "x"), (None, "and the thing of the", "x"), (5, "the and of " * 30000, "x")], "doc_id long, text string, score string")
    rows = {r.doc_id: r for r in identify(odd, model).collect()}
    assert [rows[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3 and all(rows[k].rejected for k in (1, 2, 3, 4))
    assert rows[5].lang_pred == "en" and not rows[None].rejected
    assert identify(odd.limit(0), model).count() == 0


FOREIGN = [
    "La città era tranquilla quella mattina e il mercato apriva lentamente mentre le persone arrivavano da ogni parte della regione per comprare il pane.",
    "De stad was die ochtend rustig en de markt ging langzaam open terwijl mensen uit de hele streek aankwamen om brood en fruit te kopen.",
    "Kaupunki oli sinä aamuna hiljainen ja tori avautui hitaasti, kun ihmisiä saapui kaikkialta ostamaan leipää ja hedelmiä.",
    "Miasto było tego ranka ciche, a targ otwierał się powoli, podczas gdy ludzie przybywali z całego regionu, aby kupić chleb i owoce.",
    "Şehir o sabah sessizdi ve pazar yavaş yavaş açılırken bölgenin her yerinden insanlar ekmek ve meyve almaya geliyordu.",
    "Mji ulikuwa kimya asubuhi hiyo na soko lilifunguliwa polepole huku watu wakifika kutoka kila mahali kununua mkate na matunda.",
    "for (int i = 0; i < n; i++) { sum += a[i] * b[i]; } return sum; if (x == NULL) { free(ptr); ptr = malloc(sizeof(struct node)); }",
    "xkq zvj wqpl bnrt ghjk zzxq vwty plmk qwrt jhgf dsqz xcvb nmlk poiu ytrw qsdf ghjk lmwx cvbn",
]


def test_unlearnt_languages_are_rejected_and_short_texts_are_not(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = fit(docs.filter(fold() != 1))
    odd = spark.createDataFrame([(k, t * n) for k, t in enumerate(FOREIGN) for n in (1, 8)], "doc_id int, text string")
    assert identify(odd, model).filter("not rejected").count() == 0
    held = docs.filter(fold() == 1).filter("text rlike '[a-zA-Z]'")
    short = held.withColumn("text", F.concat_ws(" ", F.slice(F.split("text", " "), 1, 6)))
    for rows in (held, short):
        assert identify(rows, model).filter("rejected").count() <= 0.01 * rows.count()


def test_a_language_of_copies_is_learnt(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("lang in ('de', 'fr')")
    one = docs.filter("lang = 'de'").limit(1).crossJoin(spark.range(20000)).drop("id")
    model = fit(docs.unionByName(one), sample=200)
    got = identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id")
    assert model.languages == ["de", "fr"] and got.filter("lang = lang_pred").count() >= 0.97 * got.count()


def test_accepted_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = spark.createDataFrame([(10**6, "Привет, как дела? " * 20, "en", "s", 1), (10**6 + 1, None, "en", "s", 0)], docs.schema)
    got = accepted(docs.unionByName(odd))
    assert got.columns == docs.columns and got.filter("doc_id < 1000000").count() == docs.count() and got.filter("doc_id >= 1000000").count() == 0
    assert accepted(docs.limit(0)).count() == 0


def test_fit_is_the_same_each_time(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    a, b = fit(docs), fit(docs.repartition(5))
    assert a.languages == b.languages and np.allclose(a.centres, b.centres)
    none = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")))
    assert set(r.lang_pred for r in identify(docs, none).collect()) == {"und"}


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = cotrain.fit(docs, labels)
    scored = cotrain.score_quality(docs, model)
    assert scored.count() == docs.count()
    rows = scored.join(labels, "doc_id").filter(fold() == 1).collect()
    right = np.mean([r.good == (r.quality == 1) for r in rows])
    pairs = [(a.score > b.score) + (a.score == b.score) / 2 for a in rows if a.quality for b in rows if not b.quality]
    assert right >= 0.9 and np.mean(pairs) >= 0.9, (right, np.mean(pairs))
    odd = spark.createDataFrame([(1, None, None, None, "x"), (None, "", "s", "en", "x"), (2, "word " * 50000, "s", "en", "x")], "doc_id long, text string, source string, lang string, score string")
    assert all(0 <= r.score <= 1 for r in cotrain.score_quality(odd, model).collect()) and cotrain.score_quality(odd.limit(0), model).count() == 0
    assert cotrain.fit(docs, labels.limit(0)) is None and cotrain.score_quality(odd, None).filter("score = 0.5").count() == 3
