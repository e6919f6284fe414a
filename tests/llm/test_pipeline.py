import random

import corpus_pipeline
from claimloom.llm import decontaminate, langid, secrets


def _tables(spark, folder):
    r = random.Random(9)
    parts = {"aa": ["the", "thing", "ing", "oth"], "bb": ["que", "eau", "ment", "oui"]}
    word = lambda k: "".join(r.choice(parts[k]) for _ in range(r.randint(1, 4)))
    items = [(i, " ".join(word("aa") for _ in range(14))) for i in range(4)]
    rows = []
    for i in range(80):
        k = r.choice(["aa", "bb"])
        rows.append([i, " ".join(word(k) for _ in range(r.randint(20, 80))), k, f"src{i % 4}"])
    rows[10][1] += " " + items[2][1]
    rows[11][1] += ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" end'
    rows[4][1] = " ".join(word(rows[4][2]) for _ in range(70))
    rows += [[84, rows[4][1] + " thing", rows[4][2], "src1"]]
    rows += [[80, rows[3][1], "aa", "src1"], [81, rows[3][1], "aa", None], [82, "123 !?", "aa", "src0"], [83, None, None, None]]
    docs = [(*x, len(x[1] or "")) for x in rows]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, items


def test_run_equals_the_stages_by_hand(spark, tmp_path):
    docs, items = _tables(spark, str(tmp_path))
    table = spark.read.parquet(f"{tmp_path}/documents.parquet")
    model = langid.fit(table.where(~langid.held_out()))
    names, _, unsure = model.predict([d[1] for d in docs])
    kept = [d for d, n, u in zip(docs, names, unsure, strict=True) if n != "und" and not u]
    assert {d[0] for d in docs} - {d[0] for d in kept} >= {82, 83}
    words = {d[0]: d[1].lower().split() for d in kept}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, w in words.items()}
    home = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                low, high = sorted((home[a], home[b]))
                home = {k: low if v == high else v for k, v in home.items()}
    kept = [d for d in kept if home[d[0]] == d[0]]
    index = decontaminate.Index(items, 5, 0.8)
    kept = [d for d in kept if not index.matches(d[1], decontaminate._Hashes(), {})]
    ids = {d[0] for d in kept}
    assert 10 not in ids and not {80, 84} & ids and {3, 4, 11} <= ids
    clean = {d[0]: secrets.redacted(d[1]) for d in kept}
    assert "<assign>" in clean[11]
    sizes, source = {}, {d[0]: d[3] for d in kept}
    for d, text in clean.items():
        sizes[source[d]] = sizes.get(source[d], 0) + len(text.split())
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in found} <= ids and all(r.text == clean[r.doc_id] and r.size == len(r.text.split()) for r in found)
    for s in sizes:
        own = [r for r in found if r.source == s]
        assert all(r.source_size == sizes[s] for r in own) and abs(sum(r.taken for r in own) - own[0].target) <= 0.5 + 1e-6
    assert abs(sum({r.source: r.target for r in found}.values()) - sum(sizes.values())) < 1e-6
    assert [r.position for r in found] == sorted(r.position for r in found)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_redaction", "source_mixing"]


def test_stages_on_empty_tables_and_clashing_columns(spark, tmp_path):
    docs, _ = _tables(spark, str(tmp_path))
    whole = spark.read.parquet(f"{tmp_path}/documents.parquet")
    empty = str(tmp_path / "empty")
    whole.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    odd = whole.selectExpr("*", "doc_id as key", "text as fp", "lang as lang_pred", "1 as base", "'x' as spans", "2 as root", "3 as component", "array(1) as cells", "4 as n")
    odd = odd.unionByName(odd.where("doc_id in (5, 83)")).unionByName(odd.where("doc_id = 6").selectExpr("cast(null as long) as doc_id", *[f"`{c}`" for c in odd.columns if c != "doc_id"]))
    rows = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, empty)
        assert rows.columns == odd.columns, name
        rows.write.parquet(str(tmp_path / name))
        rows = spark.read.parquet(str(tmp_path / name))
    kept = {r.doc_id for r in rows.collect()}
    assert 83 not in kept and {5, 6, 10} <= kept and None not in kept
    mixed = corpus_pipeline.STAGES[-1][1](spark, rows, empty)
    assert {"key", "fp", "spans", "n"} <= set(mixed.columns) and {r.doc_id for r in mixed.collect()} <= kept


def test_an_integer_length_follows_and_others_stay(spark):
    docs = spark.createDataFrame([(1, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"', "long", 5)], "doc_id long, text string, n_chars string, other int")
    assert secrets.redact(docs).first().n_chars == "long"
    row = secrets.redact(docs, length_col="other").first()
    assert row.other == len(row.text)
