"""The training-data operators against brute force, round trips and held-out accuracy."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm import chat, decontaminate, exact_dedup, language, licenses, near_copies, pieces, simhash, token_counts, toxicity, warc
from lodestone.llm.prefix_bpe import PrefixBpe
from lodestone.llm.queries import tokenizer_path
from lodestone.llm.workspace import Workspace

WORD = tokenizer_path("word_bpe_49k.json")
PIECE = tokenizer_path("piece_bpe_32k.model")
DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.001"


def docs(spark, *texts, first=0):
    return spark.createDataFrame([(first + k, t) for k, t in enumerate(texts)], DOCS)


ODD = [None, "", "", " ", "a", "a", "same text " * 900, "same text " * 900, "same text " * 899 + "Same text ", "é" * 5000, "x" * 4096, "x" * 4097, "\n\n", None]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, null ids and clashing columns."""
    rows = [(k, t) for k, t in enumerate(ODD)] + [(5, "a"), (5, "a"), (None, "a"), (None, None)]
    return spark.createDataFrame(rows, DOCS).withColumn("rid", F.lit("r")).withColumn("name", F.lit(1)).withColumn("h", F.lit(2)).withColumn("contamination", F.lit(3)).withColumn("kept", F.lit(None).cast("boolean"))


@pytest.fixture(scope="module")
def none(odd):
    return odd.limit(0)


# 1 exact dedup


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    return groups


@pytest.mark.parametrize("options", [{}, {"block_bytes": 3}, {"block_bytes": 64, "block_hash": lambda c: F.pmod(F.xxhash64(c), F.lit(2))}])
def test_exact_dedup_groups(spark, odd, options):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    groups = brute_groups(rows)
    got = exact_dedup.exact_dedup(odd, **options).collect()
    assert len(got) == len(rows)
    by_sha = {hashlib.sha256(t.encode()).hexdigest(): ids for t, ids in groups.items()}
    for sha, ids in by_sha.items():
        own = [r for r in got if r.text_sha256 == sha]
        assert sorted(r.doc_id if r.doc_id is not None else -1 for r in own) == sorted(-1 if i is None else i for i in ids)
        assert {(r.rounds, r.name) for r in own} == {(own[0].rounds, own[0].name)}
        assert {r.keep_id for r in own} == {max((i for i in ids if i is not None), default=None)}
        assert {r.group_size for r in own} == {len(ids)} and sum(r.kept for r in own) == 1
    assert len({(r.rounds, r.name) for r in got}) == len(groups)


def test_exact_dedup_drops(spark, odd, none):
    stay = exact_dedup.drop_exact_duplicates(odd)
    assert stay.columns == odd.columns and stay.count() == len(brute_groups([(r.doc_id, r.text) for r in odd.collect()]))
    assert exact_dedup.exact_dedup(none).count() == 0 and exact_dedup.drop_exact_duplicates(none).count() == 0


def test_block_names_do_not_depend_on_partitions(spark, odd):
    texts = ["x" * n + "y" * (n % 7) for n in range(0, 900, 9)] * 2
    body = docs(spark, *texts)
    names = []
    for parts in (1, 7):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts + 1))
        got = exact_dedup.identities(body.repartition(parts), block_bytes=16).collect()
        names.append({r.text_sha256: (r.rounds, r.name) for r in got})
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert names[0] == names[1] and len(set(names[0].values())) == len(set(texts))


# 2 simhash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps, distance=4):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    nodes = list(root)
    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {f: find(f) for f in nodes}


@pytest.mark.parametrize("max_cell", [4096, 3])
def test_simhash_components(spark, max_cell):
    rng = random.Random(5)
    vocabulary = ["w%d" % k for k in range(500)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 80, 300]))]
        for _ in range(rng.choice([1, 2, 12])):
            copy = list(base)
            for _ in range(rng.randint(0, 2)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    texts += [None, "", "  ", "A b\tC  d e", "a b c d e"]
    rng.shuffle(texts)
    got = simhash.simhash_near_dedup(docs(spark, *texts), max_cell=max_cell).collect()
    fps = {k: brute_fingerprint(t) for k, t in enumerate(texts)}
    roots = brute_components(set(fps.values()))
    low = {}
    for k, f in fps.items():
        low[roots[f]] = min(low.get(roots[f], k), k)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{f:016x}", low[roots[f]]) for k, f in fps.items()}


@pytest.mark.parametrize("max_cell", [4096, 2])
def test_links_connect_all_close_pairs(spark, max_cell):
    rng = random.Random(7)
    fps = set()
    for _ in range(12):
        centre = rng.getrandbits(64)
        for _ in range(20):
            f = centre
            for b in rng.sample(range(64), rng.randint(0, 3)):
                f ^= 1 << b
            fps.add(f)
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    found = simhash.links(nodes, Workspace(spark, "links"), max_cell=max_cell).collect()
    pairs = {frozenset((r.a % 2**64, r.b % 2**64)) for r in found}
    close = {frozenset((a, b)) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4}
    assert pairs <= close
    if max_cell == 4096:
        assert pairs == close and len(found) == len(close)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p in pairs:
        a, b = p
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in map(tuple, close))


def test_links_of_a_cluster_are_few(spark):
    """2,000 distinct near copies, all within four bits: few links for each, one component."""
    rng = random.Random(8)
    centre, fps = rng.getrandbits(64), set()
    while len(fps) < 2000:
        f = centre
        for b in rng.sample(range(64), rng.randint(1, 2)):
            f ^= 1 << b
        fps.add(f)
    ws = Workspace(spark, "cluster")
    found = ws.save(simhash.links(spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long"), ws, max_cell=64), "links")
    assert found.count() < 100 * len(fps)
    roots = simhash.connected_components(found, ws)
    assert roots.count() == 2000 and roots.select("root").distinct().count() == 1


def test_simhash_edges(spark, odd, none):
    got = simhash.simhash_near_dedup(odd)
    assert got.count() == odd.count()
    assert {r.component_id for r in got.collect() if r.doc_id in (0, 1, 2, 3, 12, 13)} == {0}
    assert simhash.simhash_near_dedup(none).count() == 0
    assert simhash.drop_near_duplicates(odd).columns == odd.columns and simhash.drop_near_duplicates(none).count() == 0


def test_near_duplicates_with_null_and_shared_ids(spark):
    """Different texts stay whatever their ids; copies go; the smallest id stays."""
    rng = random.Random(9)
    texts = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(400)) for _ in range(60)) for _ in range(4)]
    for ids in ([7, 7, 7, 7], [None] * 4, [None, 3, 3, None]):
        rows = spark.createDataFrame(list(zip(ids, texts)), DOCS)
        assert sorted(r.text for r in simhash.drop_near_duplicates(rows).collect()) == sorted(texts)
        assert sorted(r.text for r in exact_dedup.drop_exact_duplicates(rows).collect()) == sorted(texts)
        copies = rows.unionByName(spark.createDataFrame([(9, texts[0]), (1, texts[3]), (None, texts[3])], DOCS)).unionByName(rows).withColumn("m", F.create_map(F.lit("a"), "text"))
        kept = simhash.drop_near_duplicates(copies).collect()
        assert sorted(r.text for r in kept) == sorted(texts) and {r.doc_id for r in kept if r.text == texts[3]} == {1}


def test_counts_after_near_dedup(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    fps = {k: brute_fingerprint(t) for k, (_, t) in enumerate(rows)}
    assert simhash.drop_near_fingerprints(odd).count() == len(set(brute_components(set(fps.values())).values()))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in simhash.drop_near_duplicates(odd).collect()) == sorted((k is None, k or 0, t or "") for k, t in brute_near_dedup(rows))


def brute_shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {" ".join(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set()


def brute_links(sets):
    """Pairs of sets with a Jaccard similarity of 0.8 or more, by an exact join."""
    have, found = {}, []
    for i, own in enumerate(sets):
        common = {}
        for x in own:
            for j in have.setdefault(x, []):
                common[j] = common.get(j, 0) + 1
            have[x].append(i)
        found += [(i, j) for j, n in common.items() if n >= 0.8 * (len(own) + len(sets[j]) - n)]
    return found


def brute_near_dedup(rows):
    """The first row of each group that links of a true similarity of 0.8 or more connect."""
    rows = sorted({(k is None, k or 0, hashlib.sha256((t or "").encode()).hexdigest()): (k, t) for k, t in rows}.items())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in brute_links([brute_shingles(t) or {""} for _, (_, t) in rows]):
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [row for i, (_, row) in enumerate(rows) if find(i) == i]


def test_near_dedup_matches_brute_force(spark):
    rng = random.Random(12)
    vocabulary = ["w%d" % k for k in range(300)]
    texts = []
    for _ in range(14):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([2, 6, 40, 120, 120, 300]))]
        for _ in range(rng.choice([1, 3, 9])):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            texts.append(" ".join(copy))
    rows = [(rng.choice([k, k, None, 3]), t) for k, t in enumerate([*texts, None, "", " ", *texts[:5]])]
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    order = lambda r: (r[0] is None, r[0] or 0, r[1] or "")
    want = brute_near_dedup(rows)
    # Rows that agree but for null and empty text are one row; either stays.
    assert sorted((order((r.doc_id, r.text)) for r in got)) == sorted(map(order, want)) and 3 < len(want) < len(texts)


def template_pages(n, changed, rng, words=200):
    vocabulary = ["w%d" % k for k in range(5000)]
    template = [rng.choice(vocabulary) for _ in range(words)]
    return [" ".join(rng.choice(vocabulary) if rng.random() < changed else w for w in template) for _ in range(n)]


@pytest.mark.parametrize("changed", [0.10, 0.03, 0.004])
def test_near_dedup_of_template_pages(spark, changed):
    """Pages of one template: unlike, near 0.8, and alike; near copies of some are found."""
    rng = random.Random(3)
    pages = template_pages(400, changed, rng)
    rows = list(enumerate(pages))
    for k in range(60):
        w = pages[k].split()
        w[rng.randrange(200)] = "other"
        rows.append((1000 + k, " ".join(w)))
    got = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == sorted(brute_near_dedup(rows))


def test_unlike_template_pages_take_no_rounds(spark, monkeypatch):
    """The tables written are the same for ten times the pages (adaptive execution makes more or
    fewer jobs of one), and no unlike page goes."""
    written, save = [], Workspace.save
    monkeypatch.setattr(Workspace, "save", lambda self, df, name: (written.append(name), save(self, df, name))[1])
    steps = []
    for n in (300, 3000):
        written.clear()
        pages = spark.createDataFrame(list(enumerate(template_pages(n, 0.10, random.Random(4)))), DOCS)
        assert near_copies.near_duplicates(pages).count() == 0
        steps.append(list(written))
    assert steps[0] == steps[1]


def test_near_dedup_recall_on_documents(spark):
    """Every true pair of the documents is in one group."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    gone = {r.doc_id for r in simhash.near_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(dict(rows)) - gone == {k for k, _ in brute_near_dedup(rows)}


def test_near_dedup_of_a_large_group(spark):
    """One group of 3,000 near copies and 40 rows of one fingerprint that are not alike."""
    rng = random.Random(1)
    base = ["w%d" % k for k in range(200)]
    rows = [(k, " ".join([*base[:150], "x%d" % k, *base[150:]])) for k in range(3000)]
    rows += [(10_000 + k, " ".join(rng.sample(base[:60], 60))) for k in range(40)]
    kept = simhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS)).collect()
    assert sorted(r.doc_id for r in kept) == [0, *range(10_000, 10_040)]


def test_a_hub_is_linked(spark):
    """One node that 100,000 others are linked to, and a chain: every node has the smallest as its root."""
    hub = spark.range(1, 100_001).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    chain = spark.range(200_000, 200_040).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    roots = simhash.connected_components(hub.union(chain), Workspace(spark, "hub"))
    got = {r.root: r["count"] for r in roots.groupBy("root").count().collect()}
    assert got == {0: 100_001, 200_000: 41}


# 3 WARC


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "b" * 300 + "é</p>"
    rows = [(5, "http://a/ b\n", big), (2, None, big), (2, "http://dup", big), (9, "u", "short"), (10, "u", "short"), (11, "u", None), (12, "u", ""), (None, "n", big), (13, "c", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("clash"))
    archives = warc.write_bundles(pages, str(tmp_path / "warc"), frame_bytes=700, bundle_bytes=2000)
    got = warc.read_bundles(archives).collect()
    assert len(got) == len(rows)
    for i, _, text in rows:
        data = (text or "").encode()
        sha = hashlib.sha256(data).hexdigest()
        own = [r for r in got if r.id == i and r.payload_digest == sha]
        assert own and all(r.payload_bytes == len(data) for r in own)
        revisit = text == big and i != 2
        assert {r.record_type for r in own} == {"revisit" if revisit else "response"}
        assert {r.refers_to for r in own} == {2 if revisit else None}
        assert all(r.payload == (None if revisit else data) for r in own)
    bundles = {r.bundle_id: warc.BundleReader(bytes(r.data)) for r in archives.collect()}
    places = warc.locate(archives).collect()
    assert len(places) == len(rows)
    assert all(warc.record_uri(bundles[p.bundle_id].record(p.frame, p.offset, p.length)["id"]) == p.record for p in places)
    import zstandard

    one = archives.first()
    whole = zstandard.ZstdDecompressor().stream_reader(bytes(one.data), read_across_frames=True).read()
    assert whole.count(b"WARC/1.1\r\n") == len(one["index"])
    assert warc.read_bundles(warc.write_bundles(pages.limit(0), str(tmp_path / "empty"))).count() == 0
    paths = warc.export_files(archives, f"file://{tmp_path}/files")
    stored = {p.rpartition("/")[2].removesuffix(".warc.zst"): open(p.removeprefix("file:"), "rb").read() for p in paths}
    assert stored == {r.bundle_id: bytes(r.data) for r in archives.collect()}


# 4 token counts


def random_texts(n, seed=3):
    rng = random.Random(seed)
    pool = "aAzéÉß '’\t\n\x0b\x1c\x85\xa0　.,!?'s're'llİıſΣςσ中文字ü ﬁ½²٣१😀👨‍👩‍👧́̂0123xyzthetheing-_&%$#`Ĳĳŉªº   ▁<s></s>\x00aaaabbb...."
    out = ["".join(rng.choice(pool) * rng.choice([1, 1, 1, 3]) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    return [*out, "", "the <|endoftext|>cat<|startoftext|>", "don't we'LL stop", "x" * 3000, "ab" * 500]


def test_token_counts_match_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    texts = random_texts(1500)
    got = {r.doc_id: r for r in token_counts.prefix_counts(docs(spark, *texts), WORD).collect()}
    assert all(got[k].n_tokens == len(library.encode(t, add_special_tokens=False).ids) and got[k].n_bytes == len(t.encode()) for k, t in enumerate(texts))
    own = token_counts.tokenizer(WORD)
    for text in ["Unbelievable truncation, isn't it?  Yes.", *texts[:60]]:
        data = text.encode()
        ends, counts = own.prefix_table(data)
        for k in range(len(text) + 1):
            prefix = text[:k]
            if own.special.search(text) is None and token_counts.WordTokenizer.PLAIN.fullmatch("".join(text.split()) or "a"):
                assert own.count_at(data, ends, counts, len(prefix.encode())) == len(library.encode(prefix, add_special_tokens=False).ids)


def test_prefix_counts_of_a_word():
    own = token_counts.tokenizer(WORD)
    word = "internationalisation"
    assert own.bpe.prefix_counts(word) == [0, *(len(own.library.encode(word[:k], add_special_tokens=False).ids) for k in range(1, len(word) + 1))]


def test_truncation(spark, odd, none):
    cut = token_counts.truncate(docs(spark, "one two three four", None, ""), WORD, 2)
    assert [r.text for r in cut.orderBy("doc_id").collect()] == ["one two", None, ""]
    assert token_counts.prefix_counts(odd, WORD).count() == odd.count() and token_counts.prefix_counts(none, WORD).count() == 0
    assert {r.n_tokens for r in token_counts.prefix_counts(odd, WORD).collect() if r.doc_id in (0, 1, 3)} == {0}


# 5 licences


PROBES = {
    "This library is distributed under the MIT license.": ("mit", True),
    "SPDX-License-Identifier: MIT": ("mit", True),
    "Veröffentlicht unter der MIT-Lizenz.": ("mit", True),
    "Publié sous licence MIT.": ("mit", True),
    "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files": ("mit", True),
    "This software is NOT licensed under the MIT License.": ("unknown", False),
    "Code is licensed under Apache License 2.0, see NOTICE.": ("apache-2.0", True),
    "Redistributions of source code must retain the above copyright notice, this list of\nconditions and the following disclaimer.": ("bsd", True),
    "Released under the BSD 2-Clause License.": ("bsd-2-clause", True),
    "Available under the GNU General Public License version 3 or later.": ("gpl-3.0", True),
    "This work is licensed under the GNU General Public License, version 2.": ("gpl-2.0", True),
    "This work is licensed under the GNU Lesser General Public License, version 3.": ("lgpl-3.0", True),
    "Released under the GNU AGPLv3.": ("agpl-3.0", True),
    "Released under GPLv3.": ("gpl-3.0", True),
    "Released under GPLv2.": ("gpl-2.0", True),
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": ("cc-by-sa-4.0", True),
    "Licensed under CC BY-SA 4.0.": ("cc-by-sa-4.0", True),
    "Licensed under CC BY-ND 4.0.": ("cc-by-nd-4.0", True),
    "Text available under CC BY-NC 4.0.": ("cc-by-nc-4.0", True),
    "Licensed under CC BY 2.0.": ("unknown", False),
    "This work is licensed under a Creative Commons Attribution 3.0 International License.": ("unknown", False),
    "Licensed under the Mozilla Public License 1.1.": ("unknown", False),
    "Released under the ISC License.": ("isc", True),
    "Released under the Unlicense.": ("unlicense", True),
    "Copyright 2021, all rights reserved.": ("unknown", False),
    "All rights reserved.": ("unknown", False),
    "He has a license to drive, and came with the apache.": None,
    "Nothing here.": None,
    "Er kam mit ihr.": None,
    "Anyone from the general public may read the notice.": None,
}


def test_license_probes(spark):
    body = docs(spark, *["first words\n\n" + k + "\n\nlast words" for k in PROBES])
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(body).collect()}
    wrong = [(k, [(x.family, x.confirmed, round(x.probability, 3)) for x in got[n]]) for n, (k, want) in enumerate(PROBES.items()) if [(x.family, x.confirmed) for x in got[n]] != ([want] if want else [])]
    assert not wrong
    assert {x.paragraph for found in got.values() for x in found} == {1}
    both = docs(spark, "Code is released under the MIT License. The text is licensed under CC BY 4.0.\nReleased under GPLv3")
    assert [(x.paragraph, x.sentence, x.family, x.confirmed) for x in licenses.scan_licenses(both).first().licenses] == [(0, 0, "mit", True), (0, 1, "cc-by-4.0", True), (0, 2, "gpl-3.0", True)]


def test_licenses_left_out_of_training_are_unknown():
    """Names of licences that no class has, in sentences that no training statement has."""
    model = licenses.train()
    names = ["Sleepycat License", "Academic Free License 3.0", "Educational Community License 2.0", "Open Data Commons License", "Q Public License 1.0", "Nokia Open Source License"]
    said = [model.probabilities(f"These files are under the {n}.") for n in names]
    assert all(p.max() < licenses.MIN_PROBABILITY or model.families[int(p.argmax())] == licenses.UNKNOWN for p in said)


def brute_scan(model, text):
    """The scan of one text in plain Python."""
    import regex

    out, cues = [], set(model.cues)
    for n, paragraph in enumerate(regex.split(r"\n[ \t\r]*\n\s*", text or "")):
        for k, s in enumerate(regex.split(r"(?<=[.!?])\s+(?=[\p{Lu}])|\n(?=[\s*#/;-]*\p{Lu})", paragraph)):
            words = licenses.words_of(s)
            if cues.isdisjoint(words):
                continue
            p = model.probabilities(s)
            best = max(range(len(p)), key=lambda i: (p[i], i))
            if p[best] < 0.5:
                continue
            family, own = licenses.FAMILIES.get(model.families[best]), {*words, *map(" ".join, zip(words, words[1:]))}
            overlap = any(len(own.intersection(t)) >= 0.6 * len(t) for t in licenses.templates(family) if t) if family else False
            right = not family or not family.versions or not own.isdisjoint(family.versions)
            other = bool(family) and (not own.isdisjoint(family.related) or (not right and not own.isdisjoint(licenses.NUMBERS)))
            other = other or re.search(licenses._DENIED, " ".join(words)) is not None
            out.append((n, k, "unknown" if other else model.families[best], overlap and right and not other))
    return out


def test_op5_matches_brute_force(spark):
    from lodestone.llm import queries

    rng, model = random.Random(6), licenses.train()
    bits = [*PROBES, "word", "MIT", "license", "GPL3", "gpl12", "\n", "\n\n", "\n \n", "; And", "Version 2.0", "é", "# Not"]
    texts = [None, "", *(" ".join(rng.choice(bits) for _ in range(rng.randint(1, 12))) for _ in range(300))]
    got = licenses.scan_licenses(docs(spark, *texts)).collect()
    assert [[(x.paragraph, x.sentence, x.family, x.confirmed) for x in r.licenses] for r in sorted(got, key=lambda r: r.doc_id)] == [brute_scan(model, t) for t in texts]
    whole = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r.doc_id: brute_scan(model, r.text) for r in whole}
    rows = queries.QUERIES["op5_licenses"](spark, SF).collect()
    assert len(rows) == len(want) and any(r.families for r in rows)
    for r in rows:
        own = want[r.doc_id]
        assert (r.n_statements, r.families, r.confirmed_families) == (len(own), ",".join(sorted({x[2] for x in own})), ",".join(sorted({x[2] for x in own if x[3]})))


def test_license_edges(spark, odd, none):
    got = licenses.scan_licenses(odd)
    assert got.count() == odd.count() and all(r.licenses == [] for r in got.collect()) and licenses.scan_licenses(none).count() == 0
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    long = docs(spark, "word license " * 20_000)
    assert licenses.scan_licenses(long).count() == 1
    clash = odd.withColumn("licenses", F.lit("mine"))
    assert {r.licenses for r in licenses.scan_licenses(clash).collect()} == {"mine"} and "_licenses" in licenses.scan_licenses(clash).columns


# 6 toxicity


def test_toxicity_held_out(spark):
    d, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    inside = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(4)) > 0
    from lodestone.llm import queries

    model = queries.toxicity_model(d, labels.where(inside))
    assert model.categories == ["low_quality", "toxic"] and len(model.models[-1].extra) == 1
    scored = toxicity.score(d.select("doc_id", "text", "lang").join(labels.where(~inside).select("doc_id", "toxic"), "doc_id"), model)
    rows = scored.select("toxic", (F.col("toxicity.toxic") >= 0.5).alias("said"), "lang").collect()
    for lang in sorted({r.lang for r in rows}):
        own = [r for r in rows if r.lang == lang]
        assert sum(r.toxic == r.said for r in own) / len(own) > 0.97 and any(r.toxic for r in own), lang


def test_toxicity_edges(spark, odd, none):
    labels = spark.createDataFrame([(4, 1), (6, 0), (99, 1), (6, 0)], "doc_id long, toxic int").withColumn("text", F.lit("zzzz")).withColumn("c0", F.lit("clash"))
    model = toxicity.train(odd, labels, {"toxic": F.col("toxic") == 1}, F.col("toxic") == 1)
    assert not any("z" in f for f in model.features)
    assert toxicity.score(odd, model).count() == odd.count() and toxicity.score(none, model).count() == 0
    assert toxicity.drop_toxic(odd, model).columns == odd.columns
    untrained = toxicity.train(none, labels.limit(0), {"a": F.lit(True), "b": F.lit(True)}, F.col("toxic") == 1)
    assert {r.toxicity.b for r in toxicity.score(odd, untrained).collect()} == {0.5}
    many = odd.unionByName(spark.range(500).select(F.lit(4).cast("long").alias("doc_id"), F.lit("a").alias("text")), allowMissingColumns=True)
    assert toxicity._sample(many, labels, [F.col("toxic") == 1], F.col("toxic") == 1, "text", "doc_id", 5, 5).count() == 2


def brute_probabilities(model, text):
    """The chain by hand: word, prefix and 4-gram counts, one model after the other."""
    import math

    counts = {}
    for word in re.findall(r"[^\W\d_]+", (text or "").lower()):
        for f in ["<" + word + ">", *("<" + word[:n] for n in range(4, 9) if n <= len(word)), *{word[k : k + 4] for k in range(len(word) - 3)}]:
            counts[f] = counts.get(f, 0) + 1
    earlier = []
    for m in model.models:
        margin = m.bias + sum(m.weights[model.index[f]] * math.log2(1 + n) for f, n in counts.items() if f in model.index) + sum(w * p for w, p in zip(m.extra, earlier, strict=True))
        earlier.append(1 / (1 + math.exp(-max(-30, min(30, margin)))))
    return earlier


def test_op6_matches_brute_force(spark):
    from lodestone.llm import queries

    d, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = queries.toxicity_model(d, labels)
    want = {r.doc_id: brute_probabilities(model, r.text)[-1] for r in d.collect()}
    got = queries.QUERIES["op6_toxicity"](spark, SF).collect()
    assert len(got) == len(want) and all(abs(r.p_toxic - want[r.doc_id]) < 2e-6 and r.toxic == (want[r.doc_id] >= 0.5) for r in got)


# 7 decontamination


def brute_contamination(text, items, window=10):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

    def fold(t):
        return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    words, hit, found = fold(text), set(), set()
    for i, t in items:
        item = fold(t)
        n = min(window, len(item))
        for k in range(len(item) - n + 1 if n else 0):
            for a in range(len(words) - n + 1):
                if words[a : a + n] == item[k : k + n]:
                    hit |= set(range(a, a + n))
                    found.add(str(i))
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300, 40])
def test_decontamination_matches_brute_force(spark, block_bytes):
    rng = random.Random(11)
    words = ["alpha", "beta", "Gamma", "delta", "x1", "é", "œuvre"]
    items = [(k, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 4, 10, 14])))) for k in range(12)] + [(3, None), (12, "- . -"), (13, "Beta Gamma delta")]
    texts = [None, "", "?!"] + [rng.choice([" ", ", ", "\n"]).join(rng.choice(words) for _ in range(60)) + " " + items[rng.randrange(12)][1] for _ in range(40)]
    body = docs(spark, *texts)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontamination_report(body, bench, block_bytes=block_bytes).collect()
    for r in got:
        c = r.contamination
        assert (c.n_words, c.n_hit, c.item_ids) == brute_contamination(r.text, items), r.text
    clean = decontaminate.decontaminate(body, bench).collect()
    assert {r.doc_id for r in clean} == {r.doc_id for r in got if not r.contamination.n_hit}
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(body, bench, mode="spans").collect()}
    for r in got:
        left = decontaminate.words_of((spans[r.doc_id] or "").encode())
        assert len(left) == r.contamination.n_words - r.contamination.n_hit


def test_decontamination_index_is_bounded(spark):
    """50 MB of benchmark in blocks: less than 1 GB an index, and marks from each of three blocks."""
    rng = random.Random(4)
    words = [("%06x" % rng.getrandbits(1 << 4 << 1)).encode() for _ in range(50_000)]
    items = [(str(k), b" ".join(rng.choices(words, k=2000))) for k in range(1000)]
    block = items[:1000]
    size = sum(len(d) for _, d in block)
    assert size > 14e6
    index = decontaminate.WindowIndex(block)
    assert 50e6 / size * index.nbytes < 1e9
    bench = spark.createDataFrame([(k, d.decode()) for k, d in items[:30]], "item_id string, text string")
    body = docs(spark, *[" ".join(d.decode().split()[5:25]) for _, d in items[:30]])
    got = decontaminate.decontamination_report(body, bench, block_bytes=160_000).collect()
    assert all(r.contamination.n_hit == 20 and str(r.doc_id) in r.contamination.item_ids for r in got)


def test_decontamination_edges(spark, odd, none):
    bench = spark.createDataFrame([(1, "same text")], "item_id long, text string")
    got = decontaminate.decontaminate(odd, bench)
    assert got.columns == odd.columns and got.count() == odd.count() - 3
    assert decontaminate.decontaminate(none, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.limit(0)).count() == odd.count()


# 8 pieces


@pytest.mark.parametrize("most", [500_000, 40])
def test_pieces_match_library(spark, most):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = [*random_texts(1500, seed=4), "a" * 30_000, "thering" * 4_300, "=" * 200, "x***.,&&& llll&&&&", "l" * 61]
    body = docs(spark, *texts)
    got = pieces.decode(pieces.encode(body, PIECE, dictionary_words=most), PIECE).collect()
    assert len(got) == len(texts) and all(r.piece_ids == library.encode(r.text) and r.decoded == library.decode(r.piece_ids) for r in got)
    assert all(r.decoded == r.text for r in got if "▁" not in r.text)


def test_lattice_is_greedy_merging(spark):
    """All words of a table, by the lattice alone, against the library."""
    import sentencepiece

    library, model = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.piece_model(PIECE)
    body = spark.read.parquet(f"{SF}/documents.parquet")
    found = pieces.dictionary(body, PIECE)
    words = {w for r in body.collect() for w in model.split(r.text)}
    assert set(found) == {w for w in words if len(w) <= pieces.LATTICE_WORD}
    assert model._words(sorted(found)) == found
    assert all(library.decode(list(memoryview(ids).cast("i"))) == w.replace("▁", " ").removeprefix(" ") for w, ids in found.items())


def test_pieces_edges(spark, odd, none):
    rows = pieces.decode(pieces.encode(odd, PIECE), PIECE).collect()
    assert len(rows) == odd.count() and all(r.decoded == r.text for r in rows) and all((r.piece_ids is None) == (r.text is None) for r in rows)
    assert pieces.encode(none, PIECE).count() == 0


def test_relational_viterbi(spark):
    rng = random.Random(2)
    table = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -rng.random() * 10 for _ in range(40)}
    words = list({"".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(60)})

    def best(word):
        score = [0.0] + [float("-inf")] * len(word)
        for e in range(1, len(word) + 1):
            for s in range(max(0, e - 16), e):
                edge = table.get(word[s:e], -20.0 if e - s == 1 else None)
                if edge is not None:
                    score[e] = max(score[e], score[s] + edge)
        return score[-1]

    rows = spark.createDataFrame([(w,) for w in [*words, "", None]], "word string")
    got = pieces.relational_viterbi(rows, spark.createDataFrame(list(table.items()), "piece string, score double")).collect()
    assert {r.word for r in got} == set(words)
    for r in got:
        assert "".join(r.path) == r.word and abs(sum(table.get(p, -20.0) for p in r.path) - best(r.word)) < 1e-6


def test_prefix_bpe_against_merging():
    rng = random.Random(9)
    merges, tokens = {}, set("abc")
    while len(merges) < 60:
        a, b = rng.choice(sorted(tokens)), rng.choice(sorted(tokens))
        if (a, b) not in merges and a + b not in tokens and len(a + b) < 9:
            merges[a, b] = len(merges)
            tokens.add(a + b)
    bpe = PrefixBpe(tokens, lambda a, b: merges.get((a, b)))

    def greedy(word):
        out = list(word)
        while best := min(((merges[p], k) for k, p in enumerate(zip(out, out[1:])) if p in merges), default=None):
            out[best[1] : best[1] + 2] = ["".join(out[best[1] : best[1] + 2])]
        return out

    for _ in range(3000):
        word = "".join(rng.choice("aabc") for _ in range(rng.randint(1, 14)))
        assert [word[a:b] for a, b in bpe.encode(word)] == greedy(word)
        pair = sorted([word, word[:4] + "ab"])
        assert [[w[a:b] for a, b in spans] for w, spans in zip(pair, bpe.encode_sorted(pair), strict=True)] == [greedy(w) for w in pair]
        assert bpe.prefix_counts(word) == [len(greedy(word[:k])) for k in range(len(word) + 1)]


# 9 chat


def brute_conversations(rows):
    out = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(c, []).append((role or "", text or ""))
    return out


@pytest.mark.parametrize("limits", [{}, {"budget": 40, "history_tokens": 15, "history_turns": 2}, {"budget": 1, "history_tokens": 0}])
def test_chat_round_trip(spark, limits):
    rng = random.Random(8)
    words = ["</s>", "[INST]", "<|end|>\n", "&lt;", "&", "<", "|>", "\n", "plain", "😀é", "", "<|user|>\n"]
    rows = []
    for c in range(30):
        roles = ["system"] * rng.randint(0, 1) + ["user", "assistant"] * rng.randint(0, 8) + ["us|>\ner<"] * rng.randint(0, 1)
        rows += [(c, k, r, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12)))) for k, r in enumerate(roles)]
    rows += [(None, 1, "assistant", "x"), (None, None, None, None), (40, 0, "assistant", None), (40, 0, "assistant", None), (41, 0, "system", "only")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("window", F.lit(1)).withColumn("t", F.lit(2))
    windows = chat.format_windows(table, **limits)
    got = {r.conv_id: r for r in chat.read_windows(windows).collect()}
    want = brute_conversations(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert list(got[c].targets) == [text for role, text in turns if role == "assistant"]
    budget = limits.get("budget", chat.BUDGET)
    seen = windows.collect()
    assert all(w.tokens <= budget or w.n_new <= 1 for w in seen)
    assert all(w.n_history <= limits.get("history_turns", chat.HISTORY_TURNS) for w in seen)
    assert sum(len(w.formatted) for w in seen) == sum(r.formatted_chars for r in got.values())
    plan = chat.read_windows(windows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert chat.format_windows(table.limit(0)).count() == 0


def test_chat_takes_token_counts(spark):
    """Windows by the counts of a tokenizer, which the library gives too; a very long text."""
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    rows = [(1, k, "assistant" if k % 2 else "user", "unbelievable internationalisation " * (k + 1)) for k in range(8)] + [(2, 0, "user", "x y " * 60_000), (2, 1, "assistant", "z")]
    table = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "row_id long, conv_id long, turn long, role string, text string")
    counted = token_counts.prefix_counts(table, WORD, id_col="row_id", tables=False).select(F.col("doc_id").alias("row_id"), "n_tokens")
    windows = chat.format_windows(table.join(counted, "row_id"), budget=60, history_tokens=20, tokens_col="n_tokens").collect()
    size = {t: len(library.encode(t, add_special_tokens=False).ids) + chat.MARK_TOKENS for *_, t in rows}
    for w in windows:
        texts = [t for c, _, _, t in rows if c == w.conv_id and f"\n{t}<|end|>" in w.formatted]
        assert w.tokens == sum(size[t] for t in texts) and (w.tokens <= 60 or w.n_new == 1)
    assert {w.conv_id for w in windows} == {1, 2} and sum(w.n_new for w in windows) == len(rows)


# 10 language


def test_language_held_out(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    inside = F.pmod("doc_id", F.lit(2)) == 0
    model = language.train(d.where(inside), per_language=100)
    rows = d.where(~inside & (F.col("n_chars") > 100)).select("text", "lang").collect()
    right = sum(model.languages[int(model.likelihood(r.text).argmax())] == r.lang for r in rows)
    assert right / len(rows) > 0.97


def test_every_language_is_trained(spark):
    rng = random.Random(3)
    names = [f"l{k:02d}" for k in range(70)]
    # Each language has letters of its own; the last ones have the fewest documents.
    texts = {x: ["".join(chr(0x4E00 + 40 * k + rng.randrange(40)) for _ in range(60)) for _ in range(1 if k > 64 else 3)] for k, x in enumerate(names)}
    rows = [(x, t) for x, own in texts.items() for t in own]
    table = spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate(rows)], "doc_id long, text string, lang string")
    model = language.train(table, trigrams=50)
    assert model.languages == names
    assert all(model.languages[int(model.likelihood(own[0]).argmax())] == x for x, own in texts.items())
    assert language.text_of("<title>one</title><nav>two</nav><noscript>three</noscript><script>no</script>").split() == ["one", "two", "three"]


def test_language_evidence(spark, none):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.train(d)
    texts = {r.lang: r.text for r in d.where("n_chars > 300").collect()}
    rows = [(k, f"https://a{k % 3}.site.{x}/p", f"<html lang='{x}'><p>{t}</p>") for k, (x, t) in enumerate([(x, t) for x, t in texts.items() for _ in range(6)])]
    rows += [(100, "https://a0.site.de/q", "<html lang='de'><p>zzz</p>"), (101, None, None), (102, "http://[bad", ""), (None, "", "<p></p>"), (100, "https://a0.site.de/q", "<html lang='de'><p>zzz</p>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit("clash"))
    got = language.identify(pages, model).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.page_id is not None and r.page_id < 100:
            assert r.lang == list(texts)[r.page_id // 6]
        if r.page_id == 100:
            assert r.lang == "de"
    assert language.identify(pages.limit(0), model).count() == 0
    unlabelled = language.identify(pages, language.train(d.limit(0))).collect()
    assert len(unlabelled) == len(rows) and {(r.lang, r.probability) for r in unlabelled} == {(None, 0.0)}
    long = spark.createDataFrame([(1, "u", "<p>" + list(texts.values())[0] * 300)], "page_id long, url string, html string")
    assert language.identify(long, model).first().lang == list(texts)[0]


def test_language_of_repeated_rows_is_trained(spark):
    same = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("zwei drei vier").alias("text"), F.lit("de").alias("lang"))
    few = spark.createDataFrame([(k, "one two three", "en") for k in range(3)], "doc_id long, text string, lang string")
    model = language.train(same.union(few), per_language=50)
    assert model.languages == ["de", "en"] and model.languages[int(model.likelihood("vier drei").argmax())] == "de"


# the registered queries


@pytest.fixture(scope="module")
def op(spark):
    from lodestone.llm import queries

    return lambda name: queries.QUERIES[name](spark, SF)


@pytest.mark.parametrize("name", ["op1_exact_dedup", "op3_warc", "op7_decontaminate"])
def test_query_matches_duckdb(op, name):
    import duckdb

    from lodestone.llm import queries

    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = op(name)
    columns = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in got.collect()), key=repr) == sorted(want, key=repr)


def test_op2_matches_brute_force(spark, op):
    fps = {r.doc_id: brute_fingerprint(r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    roots, low = brute_components(set(fps.values())), {}
    for k, f in fps.items():
        low[roots[f]] = min(low.get(roots[f], k), k)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in op("op2_simhash").collect()} == {k: (f"{f:016x}", low[roots[f]]) for k, f in fps.items()}


def test_op4_and_op8_match_the_libraries(spark, op):
    import sentencepiece
    from tokenizers import Tokenizer

    words, sp = Tokenizer.from_file(WORD), sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op("op4_token_counts").collect():
        n = len(words.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)
    rows = op("op8_sentencepiece").collect()
    want = spark.createDataFrame([(k, sp.encode(t)) for k, t in texts.items()], "doc_id long, ids array<int>").select("doc_id", F.xxhash64("ids").alias("h"), F.size("ids").alias("n"))
    assert {(r.doc_id, r.n_pieces, r.pieces_xxh64, r.round_trip) for r in rows} == {(r.doc_id, r.n, r.h, True) for r in want.collect()}


def test_op9_matches_brute_force(spark, op):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    shout = "</s>[INST] ok [/INST]"
    want = brute_conversations([*rows, (-1, 0, "user", shout), (-1, 1, "assistant", shout)])
    got = op("op9_chat").collect()
    assert {r.conv_id for r in got} == set(want)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in got:
        turns, loss = want[r.conv_id], "".join(t for role, t in want[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), digest("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), digest(loss))


def test_op10_is_right_where_pages_say_so(spark, op):
    """Every page gets a language; where the declared one is of a trained language, nearly all agree."""
    got, langs = op("op10_language").collect(), {r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang").distinct().collect()}
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count() and {r.lang for r in got} <= langs
    said = [r for r in got if r.declared in langs]
    assert said and sum(r.lang == r.declared for r in said) / len(said) > 0.9


# pipeline


def test_pipeline_matches_brute_force(spark):
    import corpus_pipeline as p

    docs_ = spark.read.parquet(f"{SF}/documents.parquet")
    model = p.queries.toxicity_model(docs_, spark.read.parquet(f"{SF}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score(docs_, model).where("toxicity.toxic >= 0.5").collect()}
    rows = {r.doc_id: r.text for r in docs_.collect() if r.doc_id not in toxic}
    last = {t: i for i, t in sorted(rows.items())}
    rows = {i: t for t, i in last.items()}
    rows = dict(brute_near_dedup(list(rows.items())))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = {i: t for i, t in rows.items() if not brute_contamination(t, items)[1]}
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = p.run(spark, SF).collect()
    assert {r.doc_id: r.piece_ids for r in got} == {i: library.encode(t) for i, t in rows.items()}
    assert all(r.round_trip and r.n_pieces == len(r.piece_ids) for r in got)
    assert 0 < len(rows) < docs_.count()


def test_pipeline_stages_on_odd_rows(spark, odd, none):
    """Nulls, empty and very long texts, repeated rows, shared and null ids, clashing columns, empty tables."""
    import corpus_pipeline as p

    rows = odd.withColumn("toxic", F.lit("mine")).withColumn("_gone", F.lit(1)).withColumn("word", F.lit(2)).withColumn("fp", F.lit(3))
    for name, stage in p.STAGES:
        out = Workspace(spark, "odd").save(stage(spark, rows, SF), "out")
        if name == "SentencePiece encoding":
            assert out.count() == rows.count() and {r.round_trip for r in out.collect()} == {True}
            continue
        assert out.columns == rows.columns and stage(spark, none, SF).count() == 0
        left, texts = [r.text or "" for r in out.collect()], {r.text or "" for r in rows.collect()}
        # Near copies go, and of blank texts one stays; the other stages lose no text.
        assert set(left) <= texts and (name == "SimHash near-dedup" or set(left) == texts)
        if "dedup" in name:
            assert len(left) == len(set(left))
        rows = out
    assert rows.count() == 6
