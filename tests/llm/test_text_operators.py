"""Token counts, the SentencePiece codec, personal data, licences and toxicity against plain models of them."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from loreweave.llm import licenses, pii, sentencepiece_codec, token_counts, toxicity

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "plain words, it's 42!", "Ünïcode Straße ǅ İ ſ", "中文字符 and 🎉 emoji", "<|endoftext|> x <|startoftext|>", "a  b\n\n\tc ▁ d",
    "x" * 3000, "é́ ﬁ ½ ² \x00\x07\xa0​", "don't we'll I'M", "plain words, it's 42!",
]
CLASH = "doc_id long, text string, n_tokens string, _text int, _id int, score int, ids int, kind int, licence int, size int"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x", 1, 1, 1, 1, 1, 1, 1) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 1, 1, 1, 1, 1, 1, 1), (3, TEXTS[3], "x", 1, 1, 1, 1, 1, 1, 1)]
    return spark.createDataFrame(rows, CLASH).repartition(3)


def key(doc_id):
    return -1 if doc_id is None else doc_id


def test_token_counts_are_the_librarys(spark, docs):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(WORD_BPE)
    want = sorted((key(i), len((t or "").encode()), len(plain.encode(t or "", add_special_tokens=False).ids)) for i, t in docs.select("doc_id", "text").collect())
    for table in (None, {}, {"plain": 1, "words": 1}):
        assert sorted((key(r.doc_id), r.n_bytes, r.n_tokens) for r in token_counts.count_tokens(docs, WORD_BPE, table=table).collect()) == want
    assert token_counts.count_tokens(docs.limit(0), WORD_BPE).count() == 0


def test_pre_tokens_of_random_plain_texts():
    from tokenizers import Tokenizer

    plain, rng = Tokenizer.from_file(WORD_BPE), random.Random(1)
    chars = [chr(c) for c in [*range(9, 14), *range(32, 127), *range(0xA1, 0x130), *range(0x131, 0x17F)]]
    for _ in range(3000):
        text = "".join(rng.choice(chars if rng.random() < 0.6 else "'stremvld '0") for _ in range(rng.randint(0, 12)))
        words = token_counts.pre_tokens(text)
        if words is not None:
            assert sum(len(e.ids) for e in plain.encode_batch_fast(words, add_special_tokens=False)) == len(plain.encode(text, add_special_tokens=False).ids), text


def test_codec_is_the_librarys_and_round_trips(spark, docs):
    import sentencepiece

    plain = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    found = sentencepiece_codec.encode(docs, PIECES)
    texts = {key(r.doc_id): r.text or "" for r in docs.collect()}
    for r in found.collect():
        assert list(r.ids) == plain.encode(texts[key(r.doc_id)])
        assert r.n_tokens == len(r.ids) and r.round_trip
    for r in sentencepiece_codec.decode(found, PIECES).collect():
        assert r.text == plain.decode(plain.encode(texts[key(r.doc_id)]))
    assert sentencepiece_codec.encode(docs.limit(0), PIECES).count() == 0


def test_codec_on_random_strings_and_ids():
    import sentencepiece

    plain, coder, rng = sentencepiece.SentencePieceProcessor(model_file=PIECES), sentencepiece_codec.Codec(PIECES), random.Random(2)
    for _ in range(1500):
        text = "".join(rng.choice("ab ▁\n\té中🎉<s>1.,'ßtheinging") for _ in range(rng.randint(0, 25)))
        assert coder.encode([coder.words(text)])[0] == plain.encode(text)
        ids = [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(300) for _ in range(rng.randint(0, 8))]
        assert coder.decode(ids) == plain.decode(ids)


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def test_pseudonyms_keep_format_and_link(spark):
    texts = {
        0: "mail Bob.Smith+x@Mail8.example.com or bob.smith+x@mail8.example.com. ip 192.168.0.1 and 999.1.1.1 end",
        1: "card 4041894974608795, 4041-8949-7460-8795 and 4041 8949 7460 8796 no",
        2: "call +1 (988) 555-2485 or 988-555-2485 or +49 988 555 2485; 123-555-1234", 3: "ssn 123-45-6789 666-45-6789 000-12-1234",
        4: "born 1987-02-28, 02/28/1987, 28.02.1987, 1987-02-30, 3000-01-01", 5: None, 6: "", 7: "plain", 8: "4041894974608795",
    }
    df = spark.createDataFrame([(i, t, 1, 1, 1) for i, t in texts.items()], "doc_id long, text string, spans int, _text int, n_found int")
    out = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    import re

    assert [out[i].n_found for i in range(9)] == [3, 2, 3, 1, 3, 0, 0, 0, 1]
    assert (out[5].text, out[6].text, out[7].text) == (None, "", "plain")
    mails = re.findall(r"\S+@\S+", out[0].text)
    assert mails[0].lower() == mails[1].rstrip(".").lower() and "smith" not in out[0].text.lower() and out[0].text.endswith("999.1.1.1 end")
    assert "192.168.0.1" not in out[0].text and all(int(o) < 256 for o in re.search(r"ip ([\d.]+)", out[0].text)[1].split("."))
    card = out[8].text
    assert luhn(card) and card != texts[8] and card in out[1].text and f"{card[:4]}-{card[4:8]}-{card[8:12]}-{card[12:]}" in out[1].text and "4041 8949 7460 8796" in out[1].text
    first, second = re.findall(r"\d{3}\)? ?-?\d{3}-\d{4}", out[2].text)[:2]
    assert re.sub(r"\D", "", first) == re.sub(r"\D", "", second) and "555-2485" not in out[2].text and "123-555-1234" in out[2].text
    assert "666-45-6789 000-12-1234" in out[3].text and "123-45-6789" not in out[3].text
    y, m, d = re.search(r"born (\d+)-(\d+)-(\d+)", out[4].text).groups()
    assert f"{m}/{d}/{y}" in out[4].text and f"{d}.{m}.{y}" in out[4].text and "1987-02-30, 3000-01-01" in out[4].text and y + m + d != "19870228"
    again = {r.doc_id: r.text for r in pii.pseudonymise(df, "other").collect()}
    assert again[8] != card and pii.pseudonymise(df.limit(0), "k").count() == 0


def test_phones_of_any_area_code_and_slash_dates_day_first(spark):
    texts = ["+1 (017) 555-7713", "(017) 555-7713", "+1 988-155-2485", "988-155-2485", "+1-100-000-0000", "31/12/1987", "1987-12-31", "31/13/1987"]
    out = {r.doc_id: r for r in pii.pseudonymise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "k").collect()}
    assert [out[i].n_found for i in range(8)] == [1, 1, 1, 1, 1, 1, 1, 0] and not any(out[i].text == t for i, t in enumerate(texts[:7]))
    assert out[0].text == "+1 " + out[1].text and out[1].text[1] in "01" and out[2].text == "+1 " + out[3].text and out[3].text[4] in "01"
    y, m, d = out[6].text.split("-")
    assert out[5].text == f"{d}/{m}/{y}"


def test_cards_beside_other_numbers(spark):
    import re

    card, spaced, amex = "4111111111111111", "4111 1111 1111 1111", "3782 822463 10005"
    texts = [f"{card} {m:02d}/26" for m in range(1, 13)] + [f"{spaced} {c:03d}" for c in range(0, 1000, 37)]
    texts += [f"item 12 {card}", f"1234 {spaced}", f"{spaced} {spaced}-{card} 7", f"{amex} 1234", f"pay {card} 02/28/1987", f"{card} 988-555-2485", f"123 988-555-2485 {card}"]
    texts += [f"12 {card} 192.168.0.1 99 77@xyz.org", "1 " * 5000 + card, "5" * 20_000, "4 111 1111 1111 11 11"]
    clear = f"{card}|{spaced}|{amex}|988-555|02/28/1987|192.168|77@xyz|^4 111"
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r for r in pii.pseudonymise(df, "k").collect()}
    alone = re.sub(r"\D", "", out[0].text.split(" ")[0])
    for i, t in enumerate(texts):
        kinds = [s.kind for s in out[i].spans if s.kind]
        assert not re.search(clear, out[i].text) and (len(out[i].text) == len(t) or "192.168" in t), (t[-60:], out[i].text[-60:])
        if i < 42:  # cards and what stands beside them
            assert kinds == ["card"] and alone in re.sub(r"\D", "", out[i].text), t
        at = 0
        for s in out[i].spans:
            assert s.kind is None or not re.match("[ -]", t[at + s.skip])
            at += s.skip + s.length
            assert s.kind != "card" or luhn(re.sub(r"\D", "", out[i].text[at - s.length : at]))
    assert [s.kind for s in out[42].spans if s.kind] == ["card"] * 3 and out[42].text.endswith(" 7")


def test_no_phone_of_the_given_documents_stays(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").filter(F.col("text").rlike(r"\(\d{3}\) \d{3}-\d{4}"))
    import corpus_pipeline

    before = {r.doc_id: r.text for r in docs.collect()}
    hidden = corpus_pipeline.hide_personal_data(spark, docs, "").collect()
    import re

    seen = 0
    for r in hidden:
        phones = re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", before[r.doc_id])
        seen += len(phones)
        assert not any(p in r.text for p in phones), phones
    assert seen > 100 and len(hidden) == len(before)


@pytest.mark.parametrize("a,b", [(10, 7), (270, 270), (1000, 100)])
def test_permutation(spark, a, b):
    v = spark.range(a * b).select(pii.permute(F.col("id"), a, b, "k", "x").alias("v"))
    assert v.agg(F.countDistinct("v"), F.min("v"), F.max("v")).first()[:] == (a * b, 0, a * b - 1)


def test_pii_plan_has_no_python(spark):
    df = spark.createDataFrame([(1, "a@b.co")], "doc_id long, text string")
    plan = pii.pseudonymise(df, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_licences(spark, docs):
    texts = ["x y\nLicensed under the Apache License, Version 2.0.\nz", "Released under the MIT License.", "Licensed under CC BY-NC 4.0.",
             "This work is licensed under the GNU General Public License, version 3.", "All rights reserved.", "the version of this work", "rights of the author", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = licenses.fit(df)
    out = {r.doc_id: r for r in licenses.scan(df, model).collect()}
    assert [out[i].licence for i in range(9)] == ["Apache-2.0", "MIT", "CC-BY-NC", "GPL", "proprietary", None, None, None, None]
    span = out[0].paragraphs[0]
    assert texts[0][span.start : span.end] == "Licensed under the Apache License, Version 2.0." and span.confirmed
    assert licenses.scan(docs, model).count() == docs.count() and licenses.scan(docs.limit(0), model).count() == 0


MIT = """MIT License

Copyright (c) 2020 Ann Example

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."""
BSD = """Copyright (c) 2020, Ann Example

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."""


def test_wrapped_licences(spark):
    import textwrap

    texts, want = [], []
    for family, text in (("MIT", MIT), ("BSD", BSD)):
        for width in (30, 70, 72, 76, 80):
            for mark in ("", "# ", " * "):
                texts.append("\n".join((mark + line).rstrip() if line else "" for p in text.split("\n") for line in textwrap.wrap(p, width) or [""]))
                want.append(family)
    texts += ["Permission is hereby granted, free of charge, to any\n\nperson obtaining a copy of this software", "plain\nwords of\nthis software"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = licenses.fit(df)
    out = {r.doc_id: r for r in licenses.scan(df, model).collect()}
    assert [out[i].licence for i in range(len(texts))] == [*want, None, None]
    for i in range(len(want)):
        held = [texts[i][p.start : p.end] for p in out[i].paragraphs if p.confirmed]
        assert any(licenses.contained(licenses._words(h), want[i]) == 1 for h in held)


def test_licence_classifier_on_held_out_copies():
    import numpy as np

    model = licenses.train([["some", "version", "here"], ["rights", "of", "way"]])
    fresh = licenses._copies(np.random.default_rng(99), 20)
    right = sum(model.predict(words)[0] == family for family, words in fresh)
    assert right / len(fresh) > 0.9


def test_licences_of_the_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lines = {"Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT", "Licensed under CC BY-NC 4.0.": "CC-BY-NC",
             "This work is licensed under the GNU General Public License, version 3.": "GPL", "All rights reserved.": "proprietary"}
    want = {r.doc_id: {f for t, f in lines.items() if t in r.text.split("\n")} for r in docs.collect()}
    for r in licenses.scan(docs, licenses.fit(docs)).collect():
        assert (r.licence in want[r.doc_id]) if want[r.doc_id] else r.licence is None


def test_toxicity_held_out(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{root}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    model = toxicity.fit(docs, labels.filter(~held))
    rows = toxicity.score(docs.join(labels.filter(held), "doc_id", "left_semi"), model).join(labels, "doc_id").select("score", "toxic").collect()
    positive = [r for r in rows if r.toxic]
    assert sum(r.score >= 0.7 for r in positive) / len(positive) > 0.85  # some labels are noise
    assert sum(r.score >= 0.7 for r in rows if not r.toxic) / (len(rows) - len(positive)) < 0.015


def test_toxicity_cases(spark, docs):
    text = [(i, "Good day. You vile thing. Nice." if i % 4 == 0 else "Good day. Nice weather today. Well.") for i in range(40)]
    df = spark.createDataFrame(text, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 if i % 4 == 0 else 0) for i in range(40)] + [(None, 1), (3, None), (1, 0)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels)
    out = {r.doc_id: r for r in toxicity.score(df, model).collect()}
    assert out[0].score > 0.7 > out[1].score
    s = out[0].sentences[0]
    assert "vile" in text[0][1][s.start : s.end] and len(out[0].sentences) == 1
    p = [x for _, _, x in toxicity.score_text(text[0][1], toxicity._Weights(model))[1]]
    rest = 1.0
    for x in p:
        rest *= 1 - x
    assert abs(out[0].score - (1 - rest)) < 1e-9
    scored = toxicity.score(docs, model)
    assert scored.count() == docs.count() and scored.filter("score < 0 or score > 1 or score is null").count() == 0
    assert toxicity.keep_clean(docs, model).schema == docs.schema and toxicity.keep_clean(docs, model).count() == docs.count()
    assert toxicity.keep_clean(df, model).count() == 30
    none = toxicity.fit(df, labels.filter("toxic = 0"))
    assert toxicity.score(df, none).agg(F.max("score")).first()[0] == 0 and toxicity.score(df.limit(0), model).count() == 0


def test_codec_keeps_words_in_use_when_its_cache_is_full(monkeypatch):
    coder = sentencepiece_codec.Codec(PIECES)
    made, real = [], coder.forward
    monkeypatch.setattr(coder, "forward", lambda words: real([made.append(w) or w for w in words]))
    monkeypatch.setattr(sentencepiece_codec, "CACHE", 4)
    groups = ["one two three", "one two four five", "one two six seven"]
    found = [coder.encode([coder.words(g)])[0] for g in groups]
    assert found == [sentencepiece_codec.Codec(PIECES).encode([coder.words(g)])[0] for g in groups]
    assert sorted(made) == sorted("▁" + w for w in "one two three four five six seven".split())
