import random
import zlib

import numpy as np

from claimloom.llm import langid


def _corpus(n=240):
    r = random.Random(3)
    parts = {"aa": ["the", "thing", "ing", "oth"], "bb": ["que", "eau", "ment", "oui"], "cc": ["sch", "ung", "keit", "ein"], "dd": ["ció", "ado", "ente", "los"]}
    rows = []
    for i in range(n):
        lang = r.choice(list(parts))
        rows.append((i, " ".join("".join(r.choice(parts[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 60))), lang, "s"))
    return rows


def test_codewords_are_apart():
    for n in (2, 3, 4, 6, 9, 30):
        code = langid.codewords(n)
        assert code.shape[0] == n and set(np.unique(code)) <= {-1.0, 1.0}
        assert (abs(code.sum(0)) < n).all()
        least = min((code[i] != code[j]).sum() for i in range(n) for j in range(i))
        assert least >= (1 if n == 2 else 2)
        if n >= 4:
            assert least >= 4


def test_held_out_accuracy_and_split(spark):
    rows = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(docs.where(~langid.held_out()))
    found = langid.predict(docs.withColumn("held_out", langid.held_out()), model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) / len(held) > 0.98
    assert all(0 <= r.lang_score <= 1 for r in found)


def test_mixed_text_is_ambiguous(spark):
    rows = _corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(docs)
    one = [next(r[1] for r in rows if r[2] == k and len(r[1]) > 100)[:100] for k in ("aa", "bb")]
    names, score, unsure = model.predict([" ".join(one), one[0]])
    assert unsure.tolist() == [True, False] and names[1] == "aa" and score[1] > 0.9


def test_edges(spark):
    rows = _corpus(60) + [(1000, None, "aa", None), (1001, "123 !?", "bb", None), (None, "thing thing", None, None), (1002, "", None, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(docs)
    found = langid.predict(docs, model).where("doc_id is null or doc_id >= 1000").collect()
    assert {r.doc_id: r.lang_pred for r in found} == {1000: "und", 1001: "und", 1002: "und", None: "aa"}
    assert langid.predict(docs.limit(0), model).count() == 0
    nothing = langid.fit(docs.where("lang is null"))
    assert langid.predict(docs.limit(2), nothing).first().lang_pred == "und"
    clash = docs.withColumnRenamed("source", "lang_pred")
    assert langid.keep_identified(clash).columns == clash.columns
    assert langid.keep_identified(clash).count() == 61


def test_long_text_is_read_to_its_end(spark, monkeypatch):
    monkeypatch.setattr(langid, "_PIECE", 64)
    docs = spark.createDataFrame(_corpus(), "doc_id long, text string, lang string, source string")
    model = langid.fit(docs)
    assert model.predict(["the " * 20 + "queeau mentoui " * 400])[0] == ["bb"]


def test_prediction_equals_plain_recomputation(spark):
    import math

    rows = _corpus(90)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    model = langid.fit(docs)
    names = sorted({r[2] for r in rows})
    assert model.languages == names

    def cells(text):
        raw = b" " + b" ".join(text.lower().encode().translate(langid._AS_SPACE).split()) + b" "
        out = []
        for a, b in zip(raw, raw[1:], strict=False):
            out.append((((a * 257 + b) * 2654435761 % 2**32) >> 8) % (langid.N_CELLS // 4))
        for a, b, c in zip(raw, raw[1:], raw[2:], strict=False):
            x = ((a * 257 + b) * 263 + c) % 2**32
            out.append(langid.N_CELLS // 4 + ((x * 2246822519 % 2**32) >> 8) % (langid.N_CELLS * 3 // 4))
        return out

    share = {k: [langid.SMOOTHING] * langid.N_CELLS for k in names}
    for _, text, lang, _ in rows:
        for c in cells(text):
            share[lang][c] += 1
    for k in names:
        whole = sum(share[k])
        share[k] = [x / whole for x in share[k]]
    code = langid.codewords(4)
    weights = []
    for b in range(code.shape[1]):
        one, zero = ([k for k, w in zip(names, code[:, b], strict=True) if w == s] for s in (1, -1))
        weights.append([math.log(sum(share[k][c] for k in one) / len(one)) - math.log(sum(share[k][c] for k in zero) / len(zero)) for c in range(langid.N_CELLS)])
    expected = [[code[i, b] * sum(p * w for p, w in zip(share[k], weights[b], strict=True)) for b in range(code.shape[1])] for i, k in enumerate(names)]
    typical = [sum(e[b] for e in expected) / 4 for b in range(code.shape[1])]
    least = [min(e[b] for e in expected) for b in range(code.shape[1])]
    trust = [x * len(least) / sum(least) for x in least]
    texts = [r[1] for r in rows[:25]] + ["the que", "x"]
    for text, name, score in zip(texts, *model.predict(texts)[:2], strict=True):
        found = cells(text)
        margins = [sum(w[c] for c in found) / len(found) / t for w, t in zip(weights, typical, strict=True)]
        losses = [sum(t * math.log1p(math.exp(-langid.STEEPNESS * code[i, b] * margins[b])) for b, t in enumerate(trust)) for i in range(4)]
        near = [math.exp(min(losses) - x) for x in losses]
        assert name == names[losses.index(min(losses))] and abs(score - max(near) / sum(near)) < 1e-4


def test_many_languages_have_no_limit(spark):
    rows = [(i, f"l{i % 90:02d}x " * 20 + "abc", f"l{i % 90:02d}", "s") for i in range(450)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert len(model.languages) == 90 and model.code.shape[0] == 90
    assert langid.codewords(900).shape == (900, 99)
