from collections import defaultdict

import pytest

import corpus_pipeline
from strandwork.llm import decontaminate, quality_crf, tokens
from strandwork.session import materialize

from . import brute


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    """Short documents of the driver's table with planted copies, near copies, a shared passage and leaks; a null text."""
    d = str(tmp_path_factory.mktemp("sf"))
    src = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{src}/documents.parquet").where("length(text) < 900").orderBy("doc_id").limit(90).collect()
    bench = spark.read.parquet(f"{src}/benchmark.parquet").orderBy("item_id").limit(3).collect()
    rows = [tuple(r) for r in docs]
    passage = " ".join(f"passage{k} of words" for k in range(30))
    n = 5000
    for k, r in enumerate(docs[:24]):
        t = r.text
        t = [t, t + " One more.", t[:200] + "\n" + passage + "\n" + t[200:], t[:100] + " " + bench[k % 3].text.replace("th", "ht", 1) + " " + t[100:]][k % 4]
        rows.append((n + k, t, r.lang, r.source, len(t)))
    rows.append((6000, None, "en", "x", None))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(bench).write.parquet(f"{d}/benchmark.parquet")
    spark.read.parquet(f"{src}/labels.parquet").write.parquet(f"{d}/labels.parquet")
    return d


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    now = {r.doc_id: r.text for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "benchmark_decontamination", "packing"]

    def run(name):
        nonlocal docs
        docs = materialize(steps[name](spark, docs, sf_dir), "stage")
        assert name == "packing" or docs.columns == columns
        return {r.doc_id: r.text for r in docs.collect()} if name != "packing" else docs.collect()

    model = quality_crf.fit(docs, labels)
    good = {i for i, t in now.items() if model.score([(t or "").encode()])[0] >= quality_crf.KEEP_FROM}
    after = run("quality_classifier")
    assert after == {i: now[i] for i in good}

    first = {i: c for i, (_, c) in brute.components(after, 5, 80).items()}
    now, after = after, run("ngram_jaccard_join")
    assert after == {i: t for i, t in now.items() if first[i] == i} and len(after) < len(now)

    cut = brute.repeats(after)
    now, after = after, run("suffix_array_dedup")
    assert set(after) == set(now) and sum(x[1] for x in cut.values()) > 100
    for i, t in after.items():
        assert t == now[i] if cut[i][1] == 0 else len(t.encode()) <= cut[i][0] - cut[i][1]

    norm = lambda t: "".join(map(chr, decontaminate.normal_codes(t)[0]))
    items = [norm(r.text.strip()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {i for i, t in after.items() if all(brute.distance_inside(x, norm(t or "")) > int(len(x) * decontaminate.EDIT_RATE) for x in items)}
    now, after = after, run("benchmark_decontamination")
    assert after == {i: now[i] for i in clean} and len(after) < len(now)

    rows = run("packing")
    plain = tokens.Encoder(tokens.vocabulary("word_bpe_49k.json")).tokenizer
    pieces, seqs = defaultdict(list), defaultdict(list)
    for x in rows:
        pieces[x.doc_id].append((x.start, x.length, x.ids_crc32))
        seqs[x.sequence_id].append((x.offset, x.length))
    assert set(pieces) == set(after)
    for i, t in after.items():
        ids, at = [*plain.encode(t or "", add_special_tokens=False).ids, 1], 0
        for s, n, c in sorted(pieces[i]):
            assert s == at and c == brute.crc(ids[at : at + n])
            at += n
        assert at == len(ids)
    for v in seqs.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 2048
    assert sorted(map(repr, corpus_pipeline.run(spark, sf_dir).collect())) == sorted(map(repr, rows))
