import hashlib
import re
from collections import Counter, defaultdict

from riskloom.llm import quality

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, min_docs, share, depleted):
    carried, docs = defaultdict(set), Counter()

    def norm(line):
        return hashlib.md5(re.sub("[\x09-\x0d ]+", " ", re.sub("[0-9]", "0", line.lower())).strip(" ").encode()).hexdigest()[:16]
    for _, text, host in rows:
        docs[host] += 1
        own = sorted({norm(x) for x in (text or "").split("\n") if WORDS.search(x)})
        for x in own:
            other = [y for y in own if y != x]
            carried[host, x].add(other[0] if other else x)
    out = []
    for doc_id, text, host in rows:
        words, lines = WORDS.findall(text or ""), [x for x in (text or "").split("\n") if WORDS.search(x)]
        grams = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
        count, covered = Counter(grams), set()
        for k, g in enumerate(grams):
            if count[g] > 1:
                covered.update(range(k, k + 5))
        lost = sum(len(WORDS.findall(x)) for x in lines if len(carried[host, norm(x)]) > min_docs and len(carried[host, norm(x)]) * 100 > docs[host] * share)
        failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
        out.append((doc_id, len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), lost,
                    failed, not failed and not lost * 100 > len(words) * depleted))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_removed_words, r.base_failed, r.kept) for r in df.collect()), key=str)


def test_boilerplate_goes_copies_stay(make_docs):
    note = "Please subscribe to our letter number {} and follow us on all of the usual channels today"
    rows = [(k, note.format(k) + f"\nown {chr(97 + k)} text page", "site") for k in range(9)]
    body = "\n".join(" ".join(f"v{p}x{q}" for q in range(12)) for p in range(6))
    rows += [(100 + k, body + f"\nlast word {k} here", "site") for k in range(12)]  # near copies
    rows += [(200 + k, body, "site") for k in range(5)]  # copies
    rows += [(300 + k, " ".join(f"u{k}y{q}" for q in range(30)), "site") for k in range(30)]
    df = quality.verdicts(make_docs(rows), min_docs=4, host_share_pct=5)
    assert got(df) == brute(rows, 4, 5, quality.DEPLETED_PCT)
    kept = {r.doc_id for r in df.where("kept").collect()}
    assert kept == {r[0] for r in rows if r[0] >= 100}


def test_odd_rows(make_docs, odd_rows, clashing):
    want = brute(odd_rows, 1, 5, 70)
    assert got(quality.verdicts(make_docs(odd_rows), min_docs=1)) == want
    assert got(quality.verdicts(clashing, min_docs=1)) == want
    kept = quality.keep_good(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r[0] for r in want if r[-1])


def test_empty(make_docs):
    assert quality.verdicts(make_docs([])).count() == 0
    assert quality.keep_good(make_docs([])).count() == 0


def test_every_shared_line_counts_distinct_documents(make_docs):
    """Pages with several shared lines and few of their own: all shared lines are over the limit, copies count once."""
    shared = [f"shared line {c} of the site" for c in "abcdef"]
    rows = [(h * 100 + k, "\n".join([*shared, *[f"own {chr(97 + k % 26)}{chr(97 + k // 26)} {chr(97 + j)}" for j in range(h % 3 + 1)]]), f"host{h}")
            for h in range(12) for k in range(60)]
    copies = "\n".join(f"copied {c} text" for c in "abcd")
    rows += [(9000 + k, copies, "host0") for k in range(400)]  # one document, on both sides of the limit
    found = Counter((r.host, r.n_docs) for r in quality.frequent_lines(make_docs(rows)).collect())
    assert found == {(f"host{h}", 60): 6 for h in range(12)}


def test_kept_documents_lose_their_boilerplate(make_docs):
    from pyspark.sql import functions as F
    note = "Please follow us number {} on all of the usual channels"
    body = lambda k: [" ".join(f"u{chr(97 + k % 26)}{chr(97 + k // 26)}x{chr(97 + p)}y{chr(97 + q)}" for q in range(20)) for p in range(3)]
    rows = [(k, "\n".join([note.format(k + 10), *body(k)[:2], "", note.format(k + 11), body(k)[2]]), "site" if k % 2 else None) for k in range(60)]
    rows += [(1, rows[1][1], "site"), (100, "\n".join(body(100)), "site"), (101, note.format(55) + "\nown line", "site"), (102, note.format(57) + "\n" + body(102)[0], "other")]
    docs = make_docs(rows).withColumn("removed", F.lit(1)).withColumn("parts", F.lit("x"))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    want = [(k, "\n".join([*body(k)[:2], "", body(k)[2]])) for k in [*range(60), 1]] + [(100, rows[61][1]), (102, rows[63][1])]
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted(want)
    assert all(r.n_chars == len(r.text) for r in kept.collect())


def test_query_and_sql_agree_where_lines_are_shared(spark, make_docs):
    """Hosts of pages with six shared lines and one own, copies, null hosts and texts: the query's rows are its SQL's."""
    import duckdb
    from riskloom.llm import queries
    rows = [(h * 100 + k, "\n".join([*[f"Shared line {c} of site {h % 3}, 12 words" for c in "abcdef"][:k % 7], f"own line number {chr(97 + k % 26)}{chr(97 + k // 26)} of this page here"]),
             f"host{h}" if h else None) for h in range(8) for k in range(40)]
    rows += [(9000 + k, "copied a\ncopied b text of many words that are all the same here", "host1") for k in range(60)] + [(None, None, "host1"), (9999, "", None)]
    docs = make_docs(rows)
    got = quality.verdicts(docs).drop("row_hash").toPandas()
    db = duckdb.connect()
    db.register("documents", docs.toPandas())
    want = db.sql(queries.OP7_SQL).df()[list(got.columns)]
    key = lambda df: sorted(map(str, df.astype(object).where(df.notna(), None).itertuples(index=False, name=None)))
    as_int = lambda df: df.assign(doc_id=df["doc_id"].fillna(-1).astype(int))
    assert key(as_int(got)) == key(as_int(want)) and got["n_removed_words"].sum() > 1000
