from __future__ import annotations

import fnmatch
import math
import random
import re
from collections import deque

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codeweft.functions import similarity, text
from codeweft.operators import chunking, fusion, graph, joins, keyword, resolve, sessions, suggest, vector
from codeweft.sources import repos


def collect(df, *columns):
    return [tuple(row[c] for c in columns) for row in df.collect()]


def test_search_tokens(spark):
    cases = {
        "def Save_Order(x1): return 42": ["def", "save_order", "x1", "return", "42"],
        "größe ñandú a b_c __init__ x": ["größe", "andú", "b_c", "__init__"],
        "": [],
        "1.5 ab2 日本 x日本": ["1", "5", "ab2", "x日本"],
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string").select("t", text.search_tokens(F.col("t")).alias("k"))
    assert {row.t: row.k for row in df.collect()} == cases


def test_identifier_pieces(spark):
    cases = {
        "shop.HTTPServer2.do_GET": ["shop", "h", "t", "t", "p", "server", "2", "do", "g", "e", "t"],
        "camelCaseName": ["camel", "case", "name"],
        "": [],
        "x__y.Z9z": ["x", "y", "z", "9", "z"],
    }
    df = spark.createDataFrame([(n,) for n in cases], "n string").select("n", text.identifier_pieces(F.col("n")).alias("p"))
    assert {row.n: row.p for row in df.collect()} == cases


@pytest.mark.parametrize("pattern", ["**/*.*", "**/.git/**", "a?c/*.py", "[ab]/*", "[!ab]/x.[jt]s", "no.match", "we[ird", "a/^b$(1)+.py"])
def test_globs_match_shell_rules(spark, pattern):
    paths = ["x.py", "a/x.py", ".git/x", "s/.git/x", "abc/d.py", "b/y", "c/x.js", "c/x.ts", "no.match", "we[ird", "a/^b$(1)+.py", "a/\nb.py"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    kept = {row.p for row in df.where(text.matches_any(F.col("p"), [pattern])).collect()}
    assert kept == {p for p in paths if fnmatch.fnmatchcase(p, pattern)}


def test_path_endpoints_and_hints(spark):
    cases = {
        "Path FROM app.a to b.c please": ("app.a", "b.c"),
        "从 app.a 到 b.c": ("app.a", "b.c"),
        "??? one two three": ("one", "two"),
        "single!": ("single", "single"),
        "123": ("", ""),
    }
    df = spark.createDataFrame([(m,) for m in cases], "m string")
    found = df.select("m", text.path_endpoints(F.col("m")).alias("e"), text.symbol_hint(F.col("m")).alias("h")).collect()
    assert {r.m: (r.e.from_symbol, r.e.to_symbol) for r in found} == cases
    assert {r.m: r.h for r in found}["123"] == "123"


def brute_partial(a, b):
    if len(a) > len(b):
        a, b = b, a
    m = len(a)

    def lcs(x, y):
        row = [0] * (len(y) + 1)
        for c in x:
            previous = 0
            for j, e in enumerate(y, 1):
                previous, row[j] = row[j], previous + 1 if c == e else max(row[j], row[j - 1])
        return row[-1]

    def best(short, long):
        n = len(short)
        windows = {long[i : i + n] for i in range(len(long) - n + 1)} | {long[:i] for i in range(1, n)} | {long[-i:] for i in range(1, n)}
        return max(2 * lcs(short, w) / (n + len(w)) for w in windows)

    return max(best(a, b), best(b, a)) if m == len(b) else best(a, b)


def test_partial_ratio_against_brute_force():
    rng = random.Random(7)
    names = ["".join(rng.choice("abc._ é") for _ in range(rng.randint(1, 14))) for _ in range(120)] + ["x" * 70 + "ab"]
    table = similarity.NameTable(names)
    for query in ["ab", "c", "bca.b", "ab" * 40, "a b c", "zz"]:
        for name, got in zip(names, table.partial_ratio(query)):
            assert got == pytest.approx(brute_partial(query, name) if len(name) < 60 and len(query) < 60 else similarity.partial_ratio(query, name))


def test_similarity_bounds_hold():
    rng = random.Random(12)
    letters = "abcde._ "
    names = ["".join(rng.choices(letters, k=rng.randint(0, 14))) for _ in range(300)] + ["", " ", "a", "b a", "a" * 70, "abc" * 30]
    table = similarity.NameTable(names)
    for query in ["a", "ab", "b  a", "abcde", "edcba", "a.b_c", "abcabcabcabcabc", "x", "zzzz", "abc" * 25] + names[:40]:
        partial, whole = table.partial_ratio(query), table.token_sort_ratio(query)
        assert (table.partial_bound(query)[table.inverse] >= partial - 1e-12).all(), query
        assert (table.token_sort_bound(query)[table.inverse] >= whole - 1e-12).all(), query
        some = np.array([rng.random() < 0.5 for _ in table.names])
        for part, every in ((table.partial_ratio(query, some), partial), (table.token_sort_ratio(query, some), whole)):
            assert (part == np.where(some[table.inverse], every, 0)).all()


def test_few_names_are_compared():
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(3, 8))) for _ in range(300)]
    names = ["_".join(rng.choices(words, k=2)) for _ in range(4000)]
    rows = pa.table({"repo_id": ["r"] * 4000, "qualified_name": [f"pkg.{n}" for n in names], "name": names, "key": [f"{i:05d}" for i in range(4000)]})
    queries = [n.replace("_", "") for n in names[:20]] + [n[:3] + "x" + n[4:] for n in names[20:40]]
    asked = pa.table({"query_id": list(range(40)), "repo_id": ["r"] * 40, "query": queries, "top_n": [5] * 40})
    nearest = suggest._NearestNames(asked)
    for low in range(0, 4000, 1000):
        nearest.add(rows.slice(low, 1000))
    qnames, short = similarity.NameTable(rows["qualified_name"].to_pylist()), similarity.NameTable(names)
    got = {}
    for row in nearest.result().to_pylist():
        got.setdefault(row["query_id"], []).append(row["id"])
    for q, query in enumerate(queries):
        near = np.round(suggest._near(query, qnames, short), 9)
        assert got[q] == [f"{i:05d}" for i in np.lexsort((np.arange(4000), -near))[:5]]
    assert nearest.pairs == 160_000 and nearest.computed < 0.2 * nearest.pairs


def test_fuzzy_suggestion_against_brute_force(spark, symbols):
    queries = spark.createDataFrame([("q1", "totlup"), ("q2", "run"), ("q3", "  "), ("q4", "shop.desk.take")], "query_id string, query string")
    queries = queries.withColumn("repo_id", F.lit(symbols.first().repo_id))
    got = suggest.suggest(queries, symbols, top_n=5)
    blocks = suggest.suggest(queries, symbols, top_n=5, limit=-1)
    columns = ("query_id", "rank", "qualified_name", "id", "score")
    assert sorted(collect(got, *columns)) == sorted(collect(blocks, *columns))
    rows = symbols.collect()
    for query_id, query in [("q1", "totlup"), ("q2", "run"), ("q4", "shop.desk.take")]:
        scored = []
        for s in rows:
            q, n, low = s.qualified_name, s.name, query.lower()
            words = " ".join(sorted(query.split())), " ".join(sorted(q.split()))
            near = max(brute_partial(query, q), similarity.ratio(*words), brute_partial(query, n))
            starts = q.lower().startswith(low)
            score = 0.6 * near + 0.25 * (starts or n.lower().startswith(low)) + 0.05 * (low in (q.lower(), n.lower()))
            scored.append((-score, not starts, s.start_line, q, s.id))
        want = [(q, i) for *_, q, i in sorted(scored)[:5]]
        assert [(r.qualified_name, r.id) for r in sorted(got.where(F.col("query_id") == query_id).collect(), key=lambda r: r.rank)] == want


def test_boost_decides_between_equal_names(spark, symbols):
    repo = symbols.first().repo_id
    log = spark.createDataFrame([("s", i, "b.tool.run") for i in range(3)], "session_id string, seq int, symbol string")
    boosts = sessions.session_boosts(sessions.recent_symbols(log))
    queries = spark.createDataFrame([("x", repo, "run", "s"), ("y", repo, "run", None)], "query_id string, repo_id string, query string, session_id string")
    found = {r.query_id: r for r in suggest.disambiguate(queries, symbols, boosts).collect()}
    assert found["x"].resolved == "b.tool.run" and not found["x"].needs_user_choice
    assert found["y"].resolved is None and found["y"].needs_user_choice and len(found["y"].candidates) == 10


def test_vector_search_blocks_equal_broadcast(spark):
    stored = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.lit("r").alias("repo_id"), F.col("vec_id").alias("id"), "embedding")
    asked = stored.select(F.col("id").alias("query_id"), "repo_id", "embedding")
    columns = ("query_id", "id", "rank")
    small = collect(vector.vector_search(stored, asked, 5), *columns)
    assert sorted(small) == sorted(collect(vector.vector_search(stored, asked, 5, limit=-1), *columns))
    assert all(q == i for q, i, rank in small if rank == 1)


def test_rrf_bounds_and_ties(spark):
    schema = "query_id int, repo_id string, id string, score double, rank int"
    semantic = spark.createDataFrame([(1, "r", "a", 0.9, 1), (1, "r", "b", 0.8, 2)], schema)
    keyword_hits = spark.createDataFrame([(1, "r", "c", 7.0, 1), (1, "r", "b", 5.0, 2)], schema)
    fused = sorted(fusion.rrf_fuse(semantic, keyword_hits, 3).collect(), key=lambda r: r.rank)
    assert [r.id for r in fused] == ["b", "a", "c"]
    assert all(r.score <= 2 / 61 for r in fused)
    assert fused[1].keyword_rank is None and fused[2].semantic_rank is None


def test_bm25_shuffled_join_equals_broadcast(spark, monkeypatch):
    documents = spark.createDataFrame([("r", 1, "alpha beta beta"), ("r", 2, "alpha gamma"), ("r", 3, "delta"), ("r", 4, "")], "repo_id string, id int, text string")
    queries = spark.createDataFrame([(1, "r", "beta beta"), (2, "r", "gamma delta"), (3, "r", "none")], "query_id int, repo_id string, query string")
    index = keyword.build_keyword_index(documents)
    columns = ("query_id", "id", "rank", "score")
    got = sorted(collect(keyword.bm25_search(index, queries, 3), *columns))
    monkeypatch.setattr(keyword, "broadcast_if_small", lambda df, size_of=None: df)
    assert got == sorted(collect(keyword.bm25_search(index, queries, 3), *columns))
    assert {(q, i) for q, i, *_ in got} == {(1, 1), (2, 2), (2, 3)}


def _bm25(documents, query, k):
    """Scores of every document by the formula, best first."""
    tokens = {i: re.findall(r"[a-z_][a-z0-9_]+|[0-9]+", t.lower()) for i, t in documents}
    n, mean = len(tokens), sum(map(len, tokens.values())) / len(tokens)
    df = {}
    for words in tokens.values():
        for w in set(words):
            df[w] = df.get(w, 0) + 1
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    average = sum(raw.values()) / len(raw)
    idf = {w: x if x >= 0 else 0.25 * average for w, x in raw.items()}
    found = []
    for i, words in tokens.items():
        score = sum(idf[w] * words.count(w) * 2.5 / (words.count(w) + 1.5 * (0.25 + 0.75 * len(words) / mean)) for w in query.split() if w in words)
        if score > 0:
            found.append((-round(score, 9), i))
    return [(i, -s) for s, i in sorted(found)[:k]]


def _word_documents(rng, n):
    """Texts with some common words, one of 40 rarer words, and one of 400 rare ones; the last are copies of one."""
    def text():
        return " ".join(rng.choices(["the", "of", "and", "to"], k=rng.randint(5, 40)) + [f"mid{rng.randrange(40)}", f"rare{rng.randrange(400)}"] * rng.randint(1, 3))

    documents = [(i, text()) for i in range(n)]
    return documents + [(n + i, documents[0][1]) for i in range(60)] + [(n + 100, ""), (n + 101, "?!")]


@pytest.mark.parametrize("segment_postings, few", [(10**6, 64), (300, 64), (300, 0), (60, 0)])
def test_block_max_search_equals_scoring_everything(spark, segment_postings, few):
    rng = random.Random(8)
    documents = _word_documents(rng, 900)
    queries = [f"rare{i}" for i in range(0, 400, 9)] + ["the", "the of and to", "mid3 rare5 the", "mid7 mid7 of", "none", "none rare9", " ".join(documents[0][1].split())]
    table = spark.createDataFrame([("r", i, t) for i, t in documents], "repo_id string, id int, text string")
    asked = spark.createDataFrame([(q, "r", text) for q, text in enumerate(queries)], "query_id int, repo_id string, query string")
    index = keyword.build_keyword_index(table)
    lists = keyword.inverted_lists(index.postings, keyword.corpus_sizes(table, index.postings), segment_postings)
    index = keyword.KeywordIndex(index.postings, index.term_stats, lists.cache())
    found = {}
    for row in keyword.bm25_search(index, asked, 8, few_segments=few).orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append((row.id, round(row.score, 9)))
    for q, text in enumerate(queries):
        want = _bm25(documents, text, 8)
        got = found.get(q, [])
        assert [i for i, _ in got] == [i for i, _ in want], text
        assert [s for _, s in got] == pytest.approx([s for _, s in want])


def test_rare_terms_score_few_documents(spark):
    documents = _word_documents(random.Random(9), 3000)
    table = spark.createDataFrame([("r", i, t) for i, t in documents], "repo_id string, id int, text string")
    index = keyword.build_keyword_index(table)
    queries = [f"the rare{i} of" for i in range(0, 400, 20)]
    asked = spark.createDataFrame([(q, "r", text) for q, text in enumerate(queries)], "query_id int, repo_id string, query string")
    lists = keyword.inverted_lists(index.postings, keyword.corpus_sizes(table, index.postings), 1000).cache()
    weights, usable = keyword.search_bounds(keyword.KeywordIndex(index.postings, index.term_stats, lists), keyword.query_weights(index, asked).cache(), 3)
    read = lists.join(usable, ["repo_id", "segment"], "left_semi")
    best = keyword._BestDocuments(weights.toArrow(), 3)
    best.add(read.toArrow())
    # Every document holds "the" or "of"; the bounds leave a few blocks around the rare words.
    assert 0 < best.scored < 0.2 * len(queries) * len(documents)
    only = spark.createDataFrame([(1, "r", "rare7")], asked.schema)
    _, usable = keyword.search_bounds(keyword.KeywordIndex(index.postings, index.term_stats, lists), keyword.query_weights(index, only).cache(), 3)
    assert 0 < usable.count() < 0.5 * lists.count()


def test_sentence_chunks_cover_all_words(spark):
    rng = random.Random(3)
    long_text = " ".join(" ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(1, 40))) + rng.choice(".!?\n") for _ in range(120))
    texts = [("r", "a", long_text), ("r", "b", "word " * 1700), ("r", "c", "one. two."), ("r", "d", ""), ("r", "e", "x" * 5000)]
    docs = spark.createDataFrame(texts, "repo_id string, file_path string, text string")
    by_file = {}
    for r in chunking.sentence_chunks(docs).collect():
        by_file.setdefault(r.file_path, []).append((r.position, r.text))
    assert "d" not in by_file and by_file["c"] == [(0, "one. two.")]
    for name, source in [("a", long_text), ("b", "word " * 1700), ("e", "x" * 5000)]:
        chunks = [t.split() for _, t in sorted(by_file[name])]
        assert all(len(c) <= chunking.CHUNK_SIZE for c in chunks)
        rebuilt = list(chunks[0])
        for previous, chunk in zip(chunks, chunks[1:]):
            shared = max(n for n in range(chunking.CHUNK_OVERLAP + 1) if n == 0 or previous[-n:] == chunk[:n])
            rebuilt += chunk[shared:]
        # Repeated words may overlap further than what was carried over, never less.
        assert len(rebuilt) <= len(source.split()) and (name == "b" or rebuilt == source.split())


def test_numbering_is_dense_over_many_partitions(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "small").otherwise("large").alias("repo_id"), F.sha1(F.col("id").cast("string")).alias("file_path"))
    numbered = chunking.number_rows(rows, ["file_path"]).collect()
    for repo in ("small", "large"):
        mine = sorted((r.file_path, r.ordinal) for r in numbered if r.repo_id == repo)
        assert [o for _, o in mine] == list(range(len(mine)))


def test_spread_join_equals_plain_join(spark):
    big = spark.range(2000).select(F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 50).alias("k"), "id")
    other = spark.range(50).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    hot = joins.hot_keys(big, ["k"], 100)
    assert [r.k for r in hot.collect()] == [0]
    for how in ("inner", "left"):
        assert sorted(collect(joins.spread_join(big, other, ["k"], hot, ["id"], how), "id", "v")) == sorted(collect(big.join(other, "k", how), "id", "v"))


def test_resolution_with_hot_hints(symbols, relations):
    columns = ("src_qname", "dst_hint", "rel_type", "src_id", "dst_id", "rule")
    assert set(collect(resolve.resolve(relations, symbols), *columns)) == set(collect(resolve.resolve(relations, symbols, hot_rows=1), *columns))


def test_shortest_paths_against_search(spark):
    rng = random.Random(11)
    links = {(rng.randint(0, 39), rng.randint(0, 39)) for _ in range(70)}
    links = {(a, b) for a, b in links if a != b}
    edges = spark.createDataFrame([("r", f"n{a:02}", f"n{b:02}", "CALLS") for a, b in links], "repo_id string, src_id string, dst_id string, type string")
    wanted = [(i, "r", f"n{rng.randint(0, 39):02}", f"n{rng.randint(0, 39):02}", rng.choice([1, 2, 3, 10])) for i in range(60)]
    pairs = spark.createDataFrame(wanted, "pair_id int, repo_id string, src_id string, dst_id string, max_hops int")
    found = {r.pair_id: r.path for r in graph.shortest_paths(pairs, edges).collect()}
    out = {}
    for a, b in links:
        out.setdefault(f"n{a:02}", []).append(f"n{b:02}")
    for pair, _, src, dst, limit in wanted:
        depth, queue = {src: 0}, deque([src])
        while queue:
            node = queue.popleft()
            for nxt in out.get(node, []):
                if nxt not in depth:
                    depth[nxt] = depth[node] + 1
                    queue.append(nxt)
        if depth.get(dst, 99) > limit:
            assert pair not in found
            continue
        path = [dst]
        while path[-1] != src:
            path.append(min(n for n in depth if path[-1] in out.get(n, []) and depth[n] == depth[path[-1]] - 1))
        assert found[pair] == path[::-1]


def test_neighbors_respect_depth_and_cycles(symbols, edges):
    ids = {r.qualified_name: (r.repo_id, r.id) for r in symbols.collect()}
    names = {v: k for k, v in ids.items()}
    seeds = symbols.where(F.col("qualified_name").isin("shop.start.main", "shop.loop.ping")).select("repo_id", F.col("id").alias("seed"))
    found = {(names[r.repo_id, r.seed], names[r.repo_id, r.id], r.level) for r in graph.neighbors(seeds, edges, ["CALLS"], "out", 2).collect()}
    assert ("shop.start.main", "shop.desk.take_order", 1) in found and ("shop.start.main", "shop.bill.total_up", 2) in found
    assert ("shop.loop.ping", "shop.loop.pong", 1) in found and not any(a == b for a, b, _ in found)
    assert not any(b == "shop.vault.store_bill" and a == "shop.start.main" for a, b, _ in found)


def test_registry_keeps_latest(spark):
    paths = spark.createDataFrame([("/a/b/", 1), ("/a/b", 2), ("/c", 1)], "repo_path string, seq int")
    first = repos.register_repos(None, paths)
    again = repos.register_repos(first, spark.createDataFrame([("/c", 5)], "repo_path string, seq int"))
    assert sorted(collect(again, "repo_path", "seq")) == [("/a/b", 2), ("/c", 5)]


def test_top_n_of_a_row_and_prefixes_of_either_name(spark, symbols):
    repo = symbols.first().repo_id
    rows = [("a", repo, "SHOP.", "prefix", 2), ("b", repo, "run", "prefix", None), ("c", repo, "run", "fuzzy", 1)]
    queries = spark.createDataFrame(rows, "query_id string, repo_id string, query string, mode string, top_n int")
    got = suggest.suggest(queries, symbols, top_n=3).collect()
    counts = {q: sum(r.query_id == q for r in got) for q in "abc"}
    assert counts == {"a": 2, "b": 2, "c": 1}
    assert {r.qualified_name for r in got if r.query_id == "b"} == {"a.tool.run", "b.tool.run"}


@pytest.mark.parametrize("kind", ["array<string>", "map<string,double>", "array<double>", "struct<a:string,b:array<string>>", "array<map<string,int>>", "string"])
def test_measured_bytes_follow_arrow(spark, kind):
    from codeweft.session import measured_bytes

    value = {
        "array<string>": [f"word{i}" for i in range(40)], "map<string,double>": {f"key{i}": 0.5 for i in range(100)}, "array<double>": [0.5] * 300,
        "struct<a:string,b:array<string>>": ("x" * 50, ["abcdef"] * 30), "array<map<string,int>>": [{f"k{i}": i for i in range(9)}] * 12, "string": "y" * 400,
    }[kind]
    df = spark.createDataFrame([(value,)] * 500, f"v {kind}").coalesce(1)
    real = df.toArrow().nbytes
    assert real / 2 <= measured_bytes(df) <= 4 * real


def test_salts_follow_the_count_of_a_hot_key(spark):
    big = spark.range(1000).select(F.when(F.col("id") < 900, 1).otherwise(F.col("id")).alias("key"), "id")
    other = spark.createDataFrame([(1, "a"), (950, "b")], "key long, v string")
    hot = joins.hot_keys(big, ["key"], hot_rows=100)
    assert [(r.key, r._salts) for r in hot.collect()] == [(1, 9)]
    assert joins.spread_join(big, other, ["key"], hot, ["id"]).count() == 901


def test_keyword_blocks_equal_broadcast(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.lit("r").alias("repo_id"), F.col("doc_id").alias("id"), "text")
    asked = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.lit("r").alias("repo_id"), F.col("text").alias("query"))
    index = keyword.build_keyword_index(docs)
    columns = ("query_id", "id", "rank")
    small = collect(keyword.bm25_search(index, asked, 5), *columns)
    assert small and sorted(small) == sorted(collect(keyword.bm25_search(index, asked, 5, limit=-1), *columns))
    plan = keyword.bm25_search(index, asked, 5)._jdf.queryExecution().executedPlan().toString()
    # Nothing is exchanged by (query, document): the only shuffle is that of the best rows per query.
    assert "hashpartitioning(query_id" in plan and not re.search(r"hashpartitioning\(query_id[^)]*\bid#", plan)


def test_terms_are_counted_in_bounded_pieces():
    texts = [["a", "b", "a"], [], ["c"] * 7, ["b"], ["a", "c"]]
    batch = pa.record_batch([pa.array(["r"] * 5), pa.array(range(5)), pa.array(texts, pa.list_(pa.string()))], ["repo_id", "id", "tokens"])
    pieces = list(keyword._pieces(batch.slice(1), 4))
    assert [p.column(1).to_pylist() for p in pieces] == [[1], [2], [3, 4]]
    whole = [row for out in keyword._count_terms([batch]) for row in out.to_pylist()]
    assert [(r["id"], r["n_tokens"], dict(zip(r["terms"], r["tfs"]))) for r in whole] == [(0, 3, {"a": 2, "b": 1}), (2, 7, {"c": 7}), (3, 1, {"b": 1}), (4, 2, {"a": 1, "c": 1})]


def test_embedding_reads_texts_where_arrow_holds_them():
    from codeweft.functions.embedding import _utf8

    cuts, data = _utf8(pa.array(["x", "é", None, "", "ab"]).slice(1))
    assert [bytes(data[a:b]) for a, b in zip(cuts, cuts[1:])] == ["é".encode(), b"", b"", b"ab"]


def test_vector_search_scores_few_pairs_in_doubles(monkeypatch):
    rng = np.random.default_rng(5)
    stored = rng.normal(size=(4000, 32))
    stored[17], stored[3000] = stored[5], np.nan
    table = pa.table({"repo_id": ["r"] * 4000, "id": range(4000), "embedding": list(stored)})
    asked = table.slice(0, 100).rename_columns(["repo_id", "query_id", "embedding"])
    exact = []
    offered = vector.BestRows.offer
    monkeypatch.setattr(vector.BestRows, "offer", lambda self, scores, ids: (exact.append(scores.size), offered(self, scores, ids)))
    best = vector._NearestPerQuery(asked, 3)
    best.add(table)
    got = sorted((r["query_id"], -round(r["score"], 9), r["id"]) for r in best.result().to_pylist())
    scores = np.round(vector.relevance(stored[:100], stored), 9)
    scores[:, 3000] = -np.inf
    want = [(q, -scores[q, i], i) for q in range(100) for i in np.lexsort((np.arange(4000), -scores[q]))[:3]]
    assert [(q, i) for q, _, i in got] == [(q, i) for q, _, i in sorted(want)]
    assert sum(exact) <= 100 * 200


def test_queries_that_weigh_the_same_terms_are_one_search(spark):
    documents = spark.createDataFrame([("r", 1, "alpha beta"), ("r", 2, "alpha gamma"), ("r", 3, "delta beta beta"), ("r", 4, "omega omega"), ("r", 5, "omega")], "repo_id string, id long, text string")
    index = keyword.build_keyword_index(documents)
    asked = spark.createDataFrame([(i, "r", f"where is doc{i} beta") for i in range(9)] + [(20, "r", "beta beta")], "query_id long, repo_id string, query string")
    firsts, alike = keyword.same_searches(keyword.query_weights(index, asked))
    assert sorted(r.query_id for r in firsts.collect()) == [0, 20] and alike.count() == 10
    rows = keyword.bm25_search(index, asked, 2).collect()
    assert sorted((r.query_id, r.rank, r.id) for r in rows) == sorted((q, n, i) for q in [*range(9), 20] for n, i in ((1, 3), (2, 1)))


def test_slices_take_one_pass_over_the_text(spark):
    cases = {"": [], "abcdefgh": ["abcdefgh"], "a\nb\r\n😀é中fgh\u2028": ["a\nb\r\n😀é中", "fgh\u2028"]}
    df = spark.createDataFrame([(t,) for t in [*cases, None]], "t string").select("t", text.pieces(F.col("t")).alias("p"))
    assert {r.t: r.p for r in df.collect()} == cases | {None: []}
    # No slice by position, which walks over the text from its start.
    assert "substring" not in df._jdf.queryExecution().optimizedPlan().toString()


def test_one_text_is_compared_once_for_all_sessions(spark, monkeypatch):
    symbols = spark.createDataFrame(
        [("r", f"s{i}", f"pkg.name_{i:03d}", f"name_{i:03d}", "function", "pkg.py", i, i + 1) for i in range(40)],
        "repo_id string, id string, qualified_name string, name string, type string, file_path string, start_line long, end_line long",
    )
    asked = spark.createDataFrame([(i, "r", f"u{i}", "nmae_007") for i in range(6)] + [(9, "r", "u", "nom_03")], "query_id long, repo_id string, session_id string, query string")
    searched, search = [], suggest.batch_search
    monkeypatch.setattr(suggest, "batch_search", lambda rows, key, queries, *more: (searched.append(queries.count()), search(rows, key, queries, *more))[1])
    rows = collect(suggest.suggest(asked, symbols), "query_id", "rank", "id")
    assert searched == [2] and len(rows) == 70
    names = [f"name_{i:03d}" for i in range(40)]
    best = max(similarity.partial_ratio("nmae_007", name) for name in names)
    first = next(r[2] for r in rows if r[:2] == (0, 1))
    assert similarity.partial_ratio("nmae_007", f"name_{int(first[1:]):03d}") == best
    assert all([r[1:] for r in sorted(rows) if r[0] == i] == [r[1:] for r in sorted(rows) if r[0] == 0] for i in range(6))


def test_keys_are_counted_only_where_some_can_be_hot(symbols, relations, monkeypatch):
    asked = []
    monkeypatch.setattr(resolve, "hot_keys", lambda rows, keys, hot_rows: asked.append(rows) or joins.hot_keys(rows, keys, hot_rows))
    n = relations.select(*resolve.RELATION_COLUMNS).distinct().count()
    resolve.resolve(relations, symbols, hot_rows=4 * n).count()
    assert not asked
    resolve.resolve(relations, symbols, hot_rows=4).count()
    assert len(asked) == 1


def test_only_prefixes_of_sources_are_keys(spark, symbols):
    ranked = resolve.ranked_symbols(symbols)
    repo = ranked.first().repo_id
    sources = spark.createDataFrame([(repo, "sh"), (repo, "web"), (repo, "none")], "repo_id string, prefix string")
    every, some = resolve.symbol_keys(ranked), resolve.symbol_keys(ranked, sources)
    fixed = resolve.symbol_keys(ranked, sources.limit(0))
    assert fixed.count() < some.count() < every.count()
    wanted = ranked.select("repo_id", "name", F.explode(F.array(F.lit("sh"), F.lit("web"))).alias("place"), "qualified_name")
    wanted = wanted.where(F.col("qualified_name").startswith(F.col("place"))).select("name", "place").distinct()
    assert some.join(fixed, "key", "left_anti").count() == wanted.count()
