import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandwork.llm import chat, decision_list, decontaminate, license_scan, ngram_join, packing, quality_crf, repeats, sharding, token_io, tokens
from strandwork.session import scratch

from . import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def words(r, n, pool=400):
    return " ".join("".join(r.choice(["ka", "lo", "mi", "ner", "tu", "sha", "é"]) for _ in range(1 + r.randrange(3))) if r.random() < 0.7 else f"w{r.randrange(pool)}" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Ordinary texts, copies, near copies, a shared passage, a hot group, null, empty and a long text."""
    r = random.Random(5)
    out = [words(r, 20 + r.randrange(120)) for _ in range(60)]
    passage = words(r, 60)
    for k in range(40):
        base = out[r.randrange(60)].split(" ")
        if k % 4 == 0:
            base[r.randrange(len(base))] = "changed"
        elif k % 4 == 1:
            base[10:10] = passage.split(" ")
        out.append(" ".join(base))
    out += ["one hot text that many share and that is over one hundred bytes long so that it counts, really it does. " * 2] * 40
    out += [None, "", " \n\t", "short text", "Short TEXT", "ü" * 300, words(r, 6000), "a b c d e f g h " * 30]
    return dict(enumerate(out))


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in texts.items()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated and null ids and extra columns whose names the operators use inside."""
    long = "the same words again and again make up a text of more than one hundred bytes, which is what it takes to be cut "
    rows = [(1, long, 1, "x", 0.5), (1, long, 2, "y", None), (None, long, 3, None, 0.1), (2, long + "more", None, "z", 0.2), (2, None, 4, "z", 0.2), (3, None, 5, "", 0.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, batch int, kept_id string, score double")


def test_decontamination_finds_what_alignment_finds(spark):
    r = random.Random(3)
    items = [(k, words(r, 20 + 3 * k)) for k in range(12)] + [(50, None), (51, "  "), (52, "tiny")]
    rows, planted = [], {}
    for d in range(60):
        text = words(r, 150)
        if d % 3 == 0:
            i, t = items[r.randrange(12)]
            chars = list(t)
            for _ in range(r.randrange(0, int(len(t) * 0.12) + 1)):
                p = r.randrange(len(chars))
                chars[p : p + 1] = r.choice(["", "z", chars[p] + "q"])
            at = r.randrange(len(text))
            text = text[:at] + " " + "".join(chars).upper().replace(" ", "\n ") + " " + text[at:]
        rows.append((d, text, "en", "s", 0))
    rows += [(100, None, "en", "s", 0), (101, "", "en", "s", 0), (102, "so tiny", "en", "s", 0)]
    got = decontaminate.contamination(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(x.doc_id, x.item_id): x for x in got}
    index = decontaminate.Items([(i, t) for i, t in items if t and t.strip()], decontaminate.Q, decontaminate.EDIT_RATE)
    norm = lambda t: "".join(map(chr, decontaminate.normal_codes(t)[0]))
    for d, t, *_ in rows:
        for k, i in enumerate(index.ids):
            e = brute.distance_inside(norm(dict(items)[i].strip()), norm(t or ""))
            assert ((d, i) in found) == (e <= index.edits[k]), (d, i, e)
            if (d, i) in found:
                x = found[(d, i)]
                assert x.edits == e and brute.distance_inside(norm(t[x.start_char : x.end_char]), norm(dict(items)[i])) <= e + 1
    assert sum(1 for x in got if x.edits) >= 3 and (102, 52) in found


def test_decontamination_keeps_clean_rows(spark, docs, odd, empty):
    bench = spark.createDataFrame([(1, "the same words again and again make up a text")], "item_id long, text string")
    assert decontaminate.drop_contaminated(docs, bench).count() == docs.count()
    left = decontaminate.drop_contaminated(odd, bench)
    assert left.columns == odd.columns and sorted((x.doc_id or 0) for x in left.collect()) == [0, 3]
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).count() == 0


def test_decontamination_with_a_very_long_item(spark):
    r = random.Random(8)
    short = words(r, 30)
    long = "".join(r.choice("abcdefgh ") for _ in range((1 << 20) + 99))
    items = spark.createDataFrame([(1, long), (2, short)], "item_id long, text string")
    got = decontaminate.contamination(spark.createDataFrame([(5, long[-40:], "en", "s", 0), (6, "x " + short, "en", "s", 0)], SCHEMA), items).collect()
    assert [(x.doc_id, x.item_id, x.edits) for x in got] == [(6, 2, 0)]
    item = words(r, 1500)  # about a band that is aligned on its own
    assert [(x[1], x[4]) for x in decontaminate.find_in([item[:50] + "?" + item[51:]], decontaminate.Items([(1, item)], 10, 0.08))] == [(0, 1)]


def test_decontamination_finds_excerpts_of_long_items(spark):
    r = random.Random(9)
    item, other = words(r, 300), words(r, 60)
    assert len(item) > 2 * decontaminate.LONG and len(other) <= decontaminate.LONG
    half, cut = item[100 : 100 + decontaminate.PIECE * 3 // 2], item[-decontaminate.PIECE * 2 : -decontaminate.PIECE // 2]
    edited = half[:200] + "zz" + half[203:]
    rows = [f"{words(r, 30)} {half} {words(r, 30)}", words(r, 40) + " " + edited, cut, f"x {item} y", words(r, 200), item[: decontaminate.PIECE // 2], other[:150]]
    docs = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in enumerate(rows)], SCHEMA)
    got = decontaminate.contamination(docs, spark.createDataFrame([(1, item), (2, other)], "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in got} == {(0, 1), (1, 1), (2, 1), (3, 1)}
    for x in got:
        assert x.edits <= 24 and (x.doc_id == 1 or (x.edits == 0 and decontaminate.lowered(rows[x.doc_id][x.start_char : x.end_char]) in decontaminate.lowered(item)))
    whole = [x for x in got if x.doc_id == 3]
    assert len(whole) == 1 and whole[0].end_char - whole[0].start_char == len(item)


def test_ngram_join(docs, texts, empty, odd):
    for n, percent in ((4, 85), (5, 80), (2, 50)):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_components(docs, n, percent).collect()}
        assert got == brute.components(texts, n, percent)
    assert ngram_join.ngram_components(empty).count() == 0
    assert {x.doc_id: x.component_id for x in ngram_join.ngram_components(odd).collect()} == {1: 1, 2: 2, 3: 3}
    assert ngram_join.drop_near_duplicates(odd).columns == odd.columns


def test_ngram_join_in_tiles(docs, texts):
    for tile in (1 << 12, 500):
        got = {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_components(docs, 3, 40, tile=tile).collect()}
        assert got == brute.components(texts, 3, 40)


def test_ngram_join_of_a_hot_group(spark):
    """Near copies of one text, some of which are only linked with each other, in blocks that are larger than a tile."""
    r = random.Random(2)
    base = words(r, 80).split(" ")
    rows = {}
    for k in range(300):
        own = list(base)
        for _ in range(k % 12):
            own[r.randrange(len(own))] = f"new{r.randrange(9)}"
        rows[k] = " ".join(own)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows.items()], SCHEMA).repartition(3)
    want = brute.components(rows, 4, 85)
    assert len({c for _, c in want.values()}) > 3
    for tile in (1 << 19, 2000):
        assert {x.doc_id: (x.n_shingles, x.component_id) for x in ngram_join.ngram_components(df, 4, 85, tile=tile).collect()} == want


def test_repeats(docs, texts, empty, odd):
    got = {x.doc_id: (x.n_bytes, x.n_removed, x.n_spans, x.kept_sha256) for x in repeats.repeat_report(docs).collect()}
    assert got == brute.repeats(texts)
    cut = {x.doc_id: x.text for x in repeats.drop_repeats(docs).collect()}
    for i, t in texts.items():
        assert cut[i] == t if got[i][1] == 0 else len(cut[i].encode()) <= got[i][0] - got[i][1]
    assert repeats.repeat_report(empty).count() == 0 and repeats.drop_repeats(empty).count() == 0
    left = repeats.drop_repeats(odd)
    assert left.columns == odd.columns and left.count() == odd.count()


def test_repeats_in_shares(docs, texts):
    from strandwork.llm.blocks import batched

    part, _, total = batched(docs)
    got = repeats._by_document(repeats.repeated_spans(part, total, occurrences_a_share=2).toArrow())
    want = brute.repeats(texts)
    assert {d: (int((e - s).sum()), len(s)) for d, (s, e) in got.items()} == {d: x[1:3] for d, x in want.items() if x[1]}


def test_suffix_sort_orders_suffixes():
    r = np.random.default_rng(1)
    data = r.integers(97, 99, 600).astype(np.uint8)
    at = r.permutation(500)[:300]
    bucket = np.sort(r.integers(0, 4, 300))
    order = repeats.suffix_sort(data, repeats.prefix_hash(data), at, bucket, 60)
    keys = [(int(bucket[k]), bytes(data[at[k] : at[k] + 60]), k) for k in range(300)]
    assert [keys[k] for k in order] == sorted(keys)


def test_quality_rules(spark, docs, texts, empty):
    real = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for d in (docs, real):
        for x in decision_list.quality_report(d, labels).join(d.select("doc_id", "text"), "doc_id").collect():
            s = brute.statistics(x.text)
            assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words) == s, x.doc_id
            assert x.base_failed == (s[0] < 20 or 100 * s[4] > 30 * s[0]) and not (x.base_failed and x.kept)
    assert decision_list.quality_report(empty, labels).count() == 0
    assert decision_list.quality_report(docs, labels.limit(0)).where("kept = base_failed").count() == 0


def test_quality_rules_of_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    got = decision_list.quality_report(odd, labels).collect()
    assert sorted((x.doc_id is not None, x.doc_id or 0, x.n_words) for x in got) == sorted((d is not None, d or 0, brute.statistics(t)[0]) for d, t in [(r.doc_id, r.text) for r in odd.collect()])
    assert all(x.base_failed and not x.kept for x in got if not x.n_words)


def test_quality_rules_reject_bad_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = decision_list.quality_report(docs, labels).join(labels, "doc_id").where("not base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    share = dict(got)
    assert share[1] > 0.98 and share.get(0, 0) < 0.4


def test_license_scan(spark, empty, odd):
    rows = [
        "Released under the MIT License.", "x the apache license, version 2.0; MIT-license apache license", "GNU General Public License", None, "", "mit licenses", "Licensed under CC BY-NC 4.0.", "mıt license",
        "permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission is hereby granted without a charge to any person obtaining a copy of this software", "Kit license general public",
        "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution of forms with modification is permitted " * 50, "general public license " * 40,
    ]
    d = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x.doc_id: x for x in license_scan.scan(d).collect()}
    for i, t in enumerate(rows):
        x = got[i]
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute.base_places(t), t
        assert set(filter(None, x.base_labels.split(","))) <= set(filter(None, x.labels.split(","))) and 0 <= x.score <= 1
    assert got[6].labels == "cc-by-nc" and got[8].labels == "mit" and got[9].labels == "" and got[11].labels == "bsd" and got[12].labels == ""
    assert license_scan.scan(empty).count() == 0 and license_scan.scan(odd).count() == odd.count()


def test_license_scan_of_official_notices(spark):
    rows = [
        ("you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation", "agpl,gpl"),
        ("you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gpl,lgpl"),
        ("you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl"),
        ("License: CC BY 4.0", "cc-by"), ("Some text. License: CC BY-SA 4.0", "cc-by-sa"), ("CC BY 4.0", "cc-by"),
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "cc-by-nc"),
        ("The contents of this file are subject to the Mozilla Public License Version 1.1", "mpl"),
        ("Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "bsd"),
        ("Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted", "isc"),
        ("hereby granted, free of charge, to any person obtaining a copy of this software", "mit"), ("charge, to any person obtaining a copy of this software", ""),
        ("the terms of the general public were about a lesser license", ""), ("by 4 0 cc", ""),
    ]
    more = [(100 + k, "a plain text about the terms of this and that") for k in range(30)]
    got = {x.doc_id: x for x in license_scan.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)] + more, "doc_id long, text string")).collect()}
    assert [got[k].labels for k in range(len(rows))] == [x for _, x in rows]
    assert all(0 <= x.score <= 1 for x in got.values()) and got[3].score == 1 and got[100].score == 0


def test_license_scan_against_brute_force(spark):
    """Labels and scores of templates with words dropped, put in or exchanged, shuffled licence words, and whole templates."""
    r = random.Random(14)
    vocabulary = sorted({w for _, t, _ in license_scan.TEMPLATES for w in t.split()})
    rows, wanted = [None, "", "mit", "license mit license mit"], {}
    for k in range(260):
        label, body, phrases = license_scan.TEMPLATES[k % len(license_scan.TEMPLATES)]
        own = body.split()
        inside = {i for p in phrases for i in range(len(own)) if own[i : i + len(p.split())] == p.split() for i in range(i, i + len(p.split()))}
        free = [i for i in range(len(own)) if i not in inside]
        for i in r.sample(free, min(len(free), len(own) // 12 + k % 2)):
            own[i] = r.choice(["", "word", own[i] + " more", r.choice(vocabulary)])
        if k % 2 == 0:
            wanted[len(rows)] = label
        rows.append(", ".join([words(r, r.randrange(30)), " ".join(own).replace("license", "License"), words(r, r.randrange(30))]))
    rows += [" ".join(r.choice(vocabulary) for _ in range(r.randrange(200))) for _ in range(60)]
    rows += [words(r, 40) for _ in range(60)] + [" ".join(t for _, t, _ in license_scan.TEMPLATES)]
    got = {x.doc_id: x for x in license_scan.scan(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(4)).collect()}
    df = Counter(w for t in rows for w in set(brute.LICENCE_WORD.findall((t or "").translate(brute.LOWER))))
    for k, t in enumerate(rows):
        labels, score = brute.licence_labels(t, df, len(rows))
        assert got[k].labels == labels and got[k].score == pytest.approx(score), t
    assert sum(x in got[k].labels.split(",") for k, x in wanted.items()) >= 0.9 * len(wanted)


def test_license_scan_on_documents(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    text = {x.doc_id: x.text for x in d.collect()}
    for x in license_scan.scan(d).collect():
        assert (x.n_words, x.n_base, x.first_word, x.last_word, x.base_labels) == brute.base_places(text[x.doc_id])


def check_shards(rows, shards=8):
    by = defaultdict(list)
    for x in rows:
        by[x.shard].append(x.slot)
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and set(by) <= set(range(shards))
    sizes = [len(by[s]) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding(docs, texts, empty, odd):
    got = sharding.shard(docs).collect()
    assert Counter(x.doc_id for x in got) == Counter(texts.keys())
    check_shards(got)
    for x in got:
        b = (texts[x.doc_id] or "").encode()
        assert (x.size, x.text_crc32, x.law, x.grown_shard) == (len(b) + 1, zlib.crc32(b), "rows", None)
    assert sharding.shard(empty).count() == 0
    check_shards(sharding.shard(odd).collect())


def test_sharding_cuts_no_link_that_fits(spark):
    """Each group of equal texts that the quotas have room for stays whole: on the driver's table, and on small tables
    where a packing by brute force keeps all groups whole."""
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    tables = [d.select("doc_id", "text")]
    for seed in (1, 2, 3):
        r = random.Random(seed)
        texts = [f"group {k}" for k in range(6) for _ in range(r.randrange(2, 5))]
        texts += [f"own {k}" for k in range(40 - len(texts))]
        tables.append(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    for t in tables:
        got = sharding.shard(t).collect()
        check_shards(got)
        text, where = {x.doc_id: x.text or "" for x in t.collect()}, defaultdict(set)
        for x in got:
            where[text[x.doc_id]].add(x.shard)
        sizes = sorted((n for n in Counter(text.values()).values() if n > 1), reverse=True)
        assert brute.fits_whole(sizes, [len(text) // 8] * 8) and all(len(v) == 1 for v in where.values())


def test_sharding_keeps_groups_together(spark):
    r = random.Random(2)
    rows = [(k, f"text {r.randrange(700)}") for k in range(2000)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_shards(got)
    at = {x.doc_id: x.shard for x in got}
    groups = defaultdict(list)
    for k, t in rows:
        groups[t].append(at[k])
    together = sum(max(Counter(v).values()) for v in groups.values()) / 2000
    assert together > 0.8  # dealt by chance it is under 0.5


def test_sharding_of_large_groups(spark):
    """Groups of 33 %, 12 % and 3 % of all rows fill as few shards as the quota allows, beside 400 pairs."""
    texts = ["hot"] * 2640 + ["warm"] * 960 + ["mild"] * 240 + [f"pair {k // 2}" for k in range(800)] + [f"own {k}" for k in range(3360)]
    got = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    check_shards(got)
    groups = defaultdict(set)
    for x in got:
        groups[texts[x.doc_id]].add(x.shard)
    assert [len(groups[t]) for t in ("hot", "warm", "mild")] == [3, 1, 1]
    assert sum(len(v) == 1 for t, v in groups.items() if t.startswith("pair")) >= 380


def test_sharding_without_unlinked_rows(spark):
    """Every row is linked, so rounds only exchange rows: quarters of the table, and groups of two to six beside them."""
    texts = ["a"] * 2000 + ["b"] * 2000 + [f"few {k % 1000}" for k in range(4000)]
    got = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    check_shards(got)
    groups = defaultdict(Counter)
    for x in got:
        groups[texts[x.doc_id]][x.shard] += 1
    assert len(groups["a"]) == len(groups["b"]) == 2
    assert sum(max(c.values()) for t, c in groups.items() if t.startswith("few")) / 4000 > 0.9


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library(name, texts):
    e = tokens.Encoder(tokens.vocabulary(name))
    some = [t or "" for t in texts.values()] + ["", " ", "  a b", "a ", "a\n\nb c", "x \n y", "tab\tq w", "<|endoftext|> z y<|endoftext|>", "é cáfe ́x", "don't we'll 'S 12 345.,", "a\r\nb c", "\n", "İ Σ ΑΣ ΑΣ. b", "\na b", "a b\n", "𝒳 x y", "FOO, foo,. Foo!! a,b |", "\x1c a", "a  b"]
    flat, size = e.encode(some)
    want = [e.tokenizer.encode(t, add_special_tokens=False).ids for t in some]
    assert size.tolist() == [len(w) for w in want] and flat.tolist() == [i for w in want for i in w]
    for t, w in zip(some, want):  # again, from the cache
        assert e.encode([t])[0].tolist() == w


ATOMS = (
    ["İ", "Σ", "ς", "ß", "ẞ", "ı", "ŉ", "ǰ", "J\u030c", "a", "B", "É", "\u0301", "\u0308", "\u0338", "\u0345", "\u0345α", "Å", "K", "Ω", "ﬁ", "ｆｕｌｌ", "Ა", "Ꮿ", "𞤀", "𝒳", "क्षि", "한", "ᄀ", "ᅡ", "ᆨ", "中文", "\U000323b0"]
    + ["<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "<|endof", " ", "  ", "\n", "\t", "\r\n", "\u00a0", "\u2003", "\u0085", "\x1c", "\x00", "\x7f", "\u200b", "\ufeff", "\u180e"]
    + ["1", "12", "٣", "Ⅷ", "²", "½", ".", ",", "!!", "|", "*", "#$%&", "<", "=", "'s", "'LL", "don't", "’s", "😀", "👩\u200d👩\u200d👧", "_", "-", "foo", "BAR", "Hello", "über", "ÑANDÚ"]
)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_encoder_is_the_library_on_random_texts(name):
    r, e = random.Random(11), tokens.Encoder(tokens.vocabulary(name))
    part = lambda: "".join(r.choice(ATOMS) for _ in range(r.randrange(1, 4))) + r.choice(["", " ", " ", " ", "\n"])
    for _ in range(10):
        some = ["".join(part() for _ in range(r.randrange(1, 14))) for _ in range(1000)]
        flat, size = e.encode(some)
        cut = np.cumsum(size) - size
        for t, a, n, w in zip(some, cut.tolist(), size.tolist(), e.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
            assert flat[a : a + n].tolist() == w.ids, t


class Asked:
    """The library, which notes what it is asked to encode."""

    def __init__(self, library) -> None:
        self.library, self.asked = library, []

    def encode_batch_fast(self, some, **more):
        self.asked += some
        return self.library.encode_batch_fast(some, **more)


def test_a_word_goes_to_the_library_once():
    """A known word isn't encoded again for other marks behind it, in whatever text it comes."""
    e = tokens.Encoder(tokens.vocabulary("byte_bpe_50k.json"))
    library, e.tokenizer = e.tokenizer, Asked(e.tokenizer)
    e.encode(["a foo bar\nbaz"])
    for t in ["b foo, bar!\nbaz...", "c foo. bar\nbaz,"]:
        e.tokenizer.asked.clear()
        assert e.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids
        assert not [x for x in e.tokenizer.asked if len(x) > 1 and x.strip(tokens.MARKS)]


def test_words_of_packing_go_to_the_library_once():
    """A vocabulary that lowers letters gets a word once for all its capitals and marks, beside words that are encoded alone."""
    e = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json"))
    library, e.tokenizer = e.tokenizer, Asked(e.tokenizer)
    e.encode(["a foo don't BAR\n12ab über"])
    for t in ["b Foo, bar!\n12AB... Über don't.", "c BAR. fOO\n12ab, DON'T, über|"]:
        e.tokenizer.asked.clear()
        assert e.encode([t])[0].tolist() == library.encode(t, add_special_tokens=False).ids
        assert not [x for x in e.tokenizer.asked if len(x) > 1 and x.strip(tokens.MARKS)]


def test_packing_of_letters_with_two_lower_case_characters(spark):
    plain = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json")).tokenizer
    rows = [(k, t) for k, t in enumerate(["a İstanbul b", "😀 1İ,", "> <İ&", "x ΑΣ. ΑΣ"])]
    got = {x.doc_id: x for x in packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, t in rows:
        ids = [*plain.encode(t, add_special_tokens=False).ids, 1]
        assert (got[k].doc_tokens, got[k].ids_crc32) == (len(ids), brute.crc(ids))


def test_token_files(spark, docs, texts, empty, odd):
    vocab = tokens.vocabulary("byte_bpe_50k.json")
    plain = tokens.Encoder(vocab).tokenizer
    start, want = 0, {}
    for i, t in sorted(texts.items()):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (start, len(ids), brute.crc(ids))
        start += len(ids)
    uri = scratch(spark, "test")
    manifest = token_io.write_tokens(docs, uri, vocab, 2, file_bytes=4000)
    assert manifest.count() > 3
    got = {x.doc_id: (x.start, x.n_tokens, x.ids_crc32) for x in token_io.read_tokens(spark, uri, manifest).collect()}
    assert got == want
    first = manifest.orderBy("name").first()
    fs, folder = token_io._open_dir(uri)
    with fs.open_output_stream(f"{folder}/part-0000000000-attempt.zst") as f:  # of an attempt that was lost: the manifest doesn't name it
        f.write(b"half")
    assert {x.doc_id: (x.start, x.n_tokens, x.ids_crc32) for x in token_io.read_tokens(spark, uri, manifest).collect()} == want
    manifest = token_io.write_tokens(docs, uri, vocab, 2, file_bytes=4000)  # written again: only the new files are left
    assert sorted(x.name for x in manifest.collect()) == sorted(x.base_name for x in fs.get_file_info(token_io.pafs.FileSelector(folder)))
    first = manifest.orderBy("name").first()
    with fs.open_input_file(f"{folder}/{first.name}") as f:
        r = token_io.Reader(f)
        assert [len(x) for x in r.find(first.first_doc)] == [want[first.first_doc][1]] and r.find(-5) == []
    with fs.open_input_file(f"{folder}/{first.name}") as f:
        raw = bytearray(f.read())
    raw[int(r.at[0]) + 7] ^= 255
    with fs.open_output_stream(f"{folder}/broken") as f:
        f.write(bytes(raw))
    with pytest.raises(Exception), fs.open_input_file(f"{folder}/broken") as f:
        token_io.Reader(f).ids(0)
    assert token_io.tokens_round_trip(empty).count() == 0
    assert sorted(x.doc_id for x in token_io.tokens_round_trip(odd).collect()) == [1, 1, 2, 2, 3]


def test_packing(docs, texts, empty, odd):
    plain = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json")).tokenizer
    for length, group in ((2048, 8192), (64, 20)):
        rows = packing.pack(docs, length=length, group_pieces=group).collect()
        by = defaultdict(list)
        for x in rows:
            by[x.doc_id].append(x)
        for i, t in texts.items():
            ids, at = [*plain.encode(t or "", add_special_tokens=False).ids, 1], 0
            for x in sorted(by[i], key=lambda x: x.start):
                assert x.start == at and x.doc_tokens == len(ids) and x.ids_crc32 == brute.crc(ids[at : at + x.length])
                at += x.length
            assert at == len(ids)
        seqs = defaultdict(list)
        for x in rows:
            seqs[x.sequence_id].append((x.offset, x.length))
        for v in seqs.values():
            at = 0
            for o, n in sorted(v):
                assert o == at
                at += n
            assert at <= length
    assert packing.pack(empty).count() == 0 and packing.pack(odd).count() == odd.count()


def test_first_fit_decreasing_is_first_fit():
    r = np.random.default_rng(0)
    sizes = np.sort(r.integers(1, 100, 500))[::-1]
    room, want = [], []
    for s in sizes.tolist():
        k = next((k for k, x in enumerate(room) if x >= s), len(room))
        if k == len(room):
            room.append(100)
        want.append((k, 100 - room[k]))
        room[k] -= s
    at, offset = packing.first_fit_decreasing(sizes, 100)
    assert list(zip(at.tolist(), offset.tolist())) == want


def test_chain_marginals_against_enumeration():
    from itertools import product

    r = np.random.default_rng(4)
    t = r.normal(size=(2, 2))
    chains = [r.normal(size=n) for n in (1, 4, 2, 7)]
    for e, got in zip(chains, quality_crf.marginal_logits(chains, t)):
        p = np.zeros((len(e), 2))
        for y in product((0, 1), repeat=len(e)):
            w = np.exp(sum(e[k] * v for k, v in enumerate(y)) + sum(t[a, b] for a, b in zip(y, y[1:])))
            for k, v in enumerate(y):
                p[k, v] += w
        assert np.allclose(got, np.log(p[:, 1] / p[:, 0]))


def test_quality_classifier(spark, docs, empty, odd):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    model = quality_crf.fit(d, labels)
    rows = quality_crf.score(d.select("doc_id", "text"), model).join(labels, "doc_id").collect()
    held = [x for x in rows if zlib.crc32(str(x.doc_id).encode()) % 5 == 0]
    good, bad = ([x.score for x in held if x.quality == q] for q in (1, 0))
    assert np.mean([np.mean(np.array(good) > b) for b in bad]) > 0.97
    assert np.mean([(x.score >= quality_crf.KEEP_FROM) == (x.quality == 1) for x in held]) > 0.95
    assert quality_crf.score(empty, model).count() == 0
    left = quality_crf.drop_low_quality(odd, labels.limit(0))
    assert left.columns == odd.columns and left.count() == odd.count()  # no labels: nothing is rejected
    assert quality_crf.score(docs, model).where("score is null or score < 0 or score > 1").count() == 0


def test_quality_classifier_fits_on_whole_texts(spark, monkeypatch):
    """Long documents go to the fit with all their lines; where that is too much, with fewer documents."""
    good, bad = "This is a line of a plain text, as they go.", "BUY ### $$$ NOW!!! <<<>>> 1234"
    rows = [(k, "\n".join([good] * (300 + k) + ([bad] * 40 if k % 2 else []))) for k in range(20)]
    labels = spark.createDataFrame([(k, 1 - k % 2) for k, _ in rows], "doc_id long, quality int")
    d, given = spark.createDataFrame(rows, "doc_id long, text string"), []
    monkeypatch.setattr(quality_crf, "train", lambda lines, quality: given.append((sorted(len(f) for f, _ in lines), quality)))
    whole = {k: len(t.split("\n")) for k, t in rows if zlib.crc32(str(k).encode()) % 5}
    quality_crf.fit(d, labels)
    assert given[0][0] == sorted(whole.values())
    monkeypatch.setattr(quality_crf, "TRAIN_LINES", 1)
    quality_crf.fit(d, labels)
    assert len(given[1][0]) == 2 and set(given[1][1]) == {0, 1} and set(given[1][0]) <= set(whole.values())


def test_chain_marginals_in_blocks(monkeypatch):
    r = np.random.default_rng(6)
    t = r.normal(size=(2, 2))
    chains = [np.clip(r.normal(size=n) * 8, -30, 30) for n in (1, 256, 900, 257, 3, 512)]
    got = quality_crf.marginal_logits(chains, t)
    for block in (5, 10**6):
        monkeypatch.setattr(quality_crf, "BLOCK", block)
        for a, b in zip(got, quality_crf.marginal_logits(chains, t)):
            assert np.allclose(a, b, rtol=0, atol=1e-9)


def test_chat_formatting_round_trip(spark):
    rows = [
        (1, 0, "system", "be <|im_end|>\n kind \\ [INST]"), (1, 1, "user", None), (1, 2, "assistant", "ü<|im_start|>x\\"), (1, 3, "assistant", ""), (2, 5, "user", "only"), (3, 0, None, "x"), (3, 0, "a\nb\\n<|nl|>", "y"), (3, 0, "a\nb\\n<|nl|>", "y"),
        (4, None, "assistant", "</s>[INST] ok [/INST]"), (None, 0, "user", "lost"), *[(9, k, "user" if k % 2 else "assistant", f"t{k}") for k in range(70)],
    ]
    got = {x.conv_id: x for x in chat.conversation_digests(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    by = defaultdict(list)
    for c, n, role, text in rows:
        if c is not None:
            by[c].append((-1 if n is None else n, role is not None, role or "", text is not None, text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        said = [(x[2], x[4]) for x in sorted(turns)]
        learnt = "".join(t for r, t in said if r == "assistant")
        x = got[c]
        assert x.n_turns == len(said) and x.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in said).encode()).hexdigest()
        assert (x.loss_chars, x.loss_sha256) == (len(learnt), hashlib.sha256(learnt.encode()).hexdigest())
    assert chat.conversation_digests(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_of_random_trees(spark):
    """Ranked branches against walking every one; repeated messages, rings, extra columns and a long text."""
    r = random.Random(21)
    rows = []
    for conv in range(12):
        for m in range(1, r.randrange(2, 30)):
            rows.append((conv, m, r.choice([None, *range(1, m)]) if m > 1 else None, r.choice(["user", "assistant"]), f"text {conv} {m}" * (9000 if m == 5 else 1), r.choice([None, 0.25, 0.5, 1.0]), "x"))
    rows += [rows[0], (50, 1, 2, "user", "ring", 1.0, "x"), (50, 2, 1, "user", "ring", 1.0, "x"), (50, 3, 1, "user", "into", 1.0, "x"), (None, 1, None, "user", "lost", 1.0, "x"), (51, None, None, "user", "lost", 1.0, "x")]
    got = {(x.conv_id, x.rank): [t.text for t in x.turns] for x in chat.parsed(chat.format_trees(spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double, rank string"), keep=3)).collect()}
    want = {}
    for conv in range(12):
        m = {x[1]: x for x in rows if x[0] == conv}
        branches = []
        for leaf in set(m) - {x[2] for x in m.values()}:
            way = [leaf]
            while m[way[-1]][2] in m:
                way.append(m[way[-1]][2])
            branches.append((-sum(m[i][5] or 0 for i in way) / len(way), -len(way), leaf, way[::-1]))
        want |= {(conv, k): [m[i][4] for i in b[3]] for k, b in enumerate(sorted(branches)[:3], 1)}
    assert got == want


def test_chat_ranks_branches(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "bad", 0.1), (1, 3, 1, "assistant", "good", 0.9), (1, 4, 3, "user", "more", 0.5), (1, 5, 4, "assistant", "end", None), (2, 7, 99, "user", "lone", 1.0)]
    m = spark.createDataFrame(rows, "conv_id long, msg_id long, parent_id long, role string, text string, score double")
    got = {(x.conv_id, x.rank): [t.text for t in x.turns] for x in chat.parsed(chat.format_trees(m, keep=2)).collect()}
    assert got == {(1, 1): ["q", "good", "more", "end"], (1, 2): ["q", "bad"], (2, 1): ["lone"]}
