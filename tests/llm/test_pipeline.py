import hashlib
import itertools
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from sagaframe.llm import mixing, simhash, toxicity


def test_stages(spark, sf_dir):
    assert [n for n, _ in P.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "poisson_mixing", "bpe_codec"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = P.drop_copies(spark, docs, sf_dir)
    by_text = {}
    for r in docs.collect():
        by_text[r.text] = max(by_text.get(r.text, -1), r.doc_id)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(by_text.values())
    near = P.drop_near_copies(spark, docs, sf_dir)
    roots = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in near.collect()) == sorted(roots)
    mixed = P.mix(spark, docs, sf_dir)
    for out in (kept, near, mixed):
        assert out.dtypes == docs.dtypes


def test_run_is_the_brute_force_pipeline(spark, sf_dir):
    """Every stage in plain Python: the model's scores word by word, dictionaries, all pairs, the library's tokens."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    model = toxicity.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    left = {i: r for i, r in docs.items() if model.scores([r.text])[0] < 0.7}
    last = {}
    for i in sorted(left):
        last[left[i].text] = i
    left = {i: left[i] for i in last.values()}
    prints = {i: simhash.fingerprint(r.text.encode()) for i, r in left.items()}
    root = {i: i for i in left}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(left), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    near = spark.createDataFrame([left[i] for i in left if find(i) == i], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    copies = Counter(r.doc_id for r in mixing.mix_sources(near).collect())  # its own brute force is in test_rules_and_mixing
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for i, n in copies.items():
        ids = library.encode(left[i].text, add_special_tokens=False).ids
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))] = n
    got = P.run(spark, sf_dir)
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.collect()) == want
    assert set(got.columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} and 50 < sum(want.values())


def test_null_and_empty_rows_pass_every_stage(spark, sf_dir):
    kind = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (4, "long words " * 100_000, "en", "s", 5), (5, "x" * 300_000, "en", "s", 5)], kind)
    for table in (docs, docs.filter("false")):
        at = table
        for _, stage in P.STAGES:
            at = stage(spark, at, sf_dir)
            at.count()
