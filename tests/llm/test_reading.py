import numpy as np

from tidebar.llm import reading as R


def test_sentences():
    assert R.sentences("We sold 12 lots. Too late!\nok\n\nThe file was odd") == [["we", "sold", "0", "lots"], ["too", "late"], ["ok"], ["the", "file", "was", "odd"]]
    assert R.sentences("hm") == [["hm"]] and R.sentences("...") == [[""]]


def test_softmax_gradient_learns_order(spark):
    easy, hard = "We got out at noon. The loss was small.", "The asymptotically negligible specification uncertainty presupposes heteroskedasticity. Subsequent scholarship problematises conditional liquidation dynamics."
    target = np.eye(4)[[0, 3] * 20]
    model = R.fit([easy, hard] * 20, target)
    p = model.predict([easy, hard, "We got out. The loss was small at noon."])
    assert p.argmax(axis=1).tolist() == [0, 3, 0]


def test_fits_as_tasks_are_the_same(spark):
    texts = [f"We got out at noon {i}." if i % 2 else f"Negligible uncertainty presupposes {i} heteroskedastic conditions." for i in range(30)]
    target = np.eye(4)[[3, 0] * 15]
    assert np.allclose(R.fit(texts, target).predict(texts), R.fit(texts, target, spark=spark).predict(texts))


def test_held_out_accuracy(small):
    import duckdb

    d = small.replace("0.001", "0.1")
    rows = duckdb.sql(f"select text, list(grade) from '{d}/documents.parquet' join '{d}/reading_label.parquet' using (doc_id) where lang = 'en' and trim(text) <> '' group by doc_id, text order by doc_id").fetchall()
    target = np.array([[g.count(k) / len(g) for k in range(1, 5)] for _, g in rows])
    cut = int(len(rows) * 0.7)
    got = R.fit([t for t, _ in rows[:cut]], target[:cut]).predict([t for t, _ in rows[cut:]]).argmax(axis=1) + 1
    agreed = [(k, g[0]) for k, (_, g) in enumerate(rows[cut:]) if len(g) > 1 and len(set(g)) == 1]
    assert np.mean([got[k] == g for k, g in agreed]) > 0.9
    assert np.mean([abs(got[k] - np.mean(g)) <= 1 for k, (_, g) in enumerate(rows[cut:])]) > 0.98


def test_operator_edges(spark):
    docs = [(i, "en", f"We got out at noon. The loss was small in week {i}.") for i in range(30)] + [(100 + i, "en", f"The asymptotically negligible uncertainty presupposes {i} heteroskedastic conditions.") for i in range(30)]
    docs += [(200, None, "We got out."), (201, "de", "Der Kurs fiel."), (202, "en", None), (203, "en", " \n"), (204, "en", "a " * 300_000), (0, "en", docs[0][2])]
    d = spark.createDataFrame([(*x, 9, 0.5) for x in docs], "doc_id long, lang string, text string, grade int, level double")
    labels = spark.createDataFrame([(i, "r", 1) for i in range(20)] + [(100 + i, "r", 4) for i in range(20)] + [(5, "q", 1), (None, "q", 2), (3, "q", None), (4, "q", 9)], "doc_id long, rater string, grade int")
    got = R.grade_documents(d, labels).collect()
    assert sorted(r.doc_id for r in got) == sorted([*range(30), *range(100, 130), 204, 0])
    grades = {r.doc_id: r.grade for r in got}
    assert grades[25] == 1 and grades[125] == 4
    assert R.grade_documents(d, labels.limit(0)).count() == 0 and R.grade_documents(d.limit(0), labels).count() == 0
    assert R.profile(R.grade_documents(d, labels)).count() >= 2


def test_grams_of_the_whole_word():
    word = "a" * 70
    assert R.grams(word + "xyz") != R.grams(word + "uvw")
    assert len(R.grams(word)) == 70 + 69
