import math
import zlib
from collections import Counter, defaultdict

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from flowsift.llm.packing import cut_points
from flowsift.llm.queries import vocabulary
from flowsift.llm.secret_scan import masked, scan
from tests.llm.test_quality import plain as plain_measures
from tests.llm.test_simhash import plain_classes

STAGES = dict(corpus_pipeline.STAGES)


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "simhash_near_dedup", "secret_scans", "best_fit_packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_whole_pipeline_equals_the_plain_version(spark, sf_dir, documents):
    rows = []
    for d in documents.collect():
        m = plain_measures(d.text)
        if not (m[0] < 10 or 100 * m[4] > 20 * m[0]):
            rows.append(d)
    first = {c for _, _, c in plain_classes(rows)}
    model = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    wanted = Counter()
    for d in (d for d in rows if d.doc_id in first):
        ids = np.array([*model.encode(masked(d.text, scan(d.text)[1], "[secret]"), add_special_tokens=False).ids, 0], "<u4")
        for k, (s, n) in enumerate(cut_points(len(ids), 2048)):
            wanted[d.doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    found = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(tuple(r[:5]) for r in found) == wanted
    bins = defaultdict(list)
    for r in found:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        ends = [o + n for o, n in sorted(parts)]
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(bins) <= math.ceil(sum(r.length for r in found) / 2048) * 1.02 + 1


def test_stages_keep_the_columns(spark, sf_dir, documents, odd_documents, empty_documents):
    for name in ("quality_rules", "simhash_near_dedup", "secret_scans"):
        for docs in (documents, odd_documents, empty_documents):
            out = STAGES[name](spark, docs, sf_dir)
            assert out.columns == docs.columns and out.count() <= docs.count()
    assert STAGES["best_fit_packing"](spark, empty_documents, sf_dir).count() == 0


def test_secret_scans_keep_every_document(spark, sf_dir, documents):
    out = STAGES["secret_scans"](spark, documents, sf_dir).collect()
    assert len(out) == documents.count()
    assert all(r.n_chars == len(r.text) and not scan(r.text)[0] for r in out)
