"""Generated queries over the movie schema, of the sizes and with the conditions of join-order workloads, against DuckDB."""

import random

import duckdb
import pytest

from millrace.catalog import MOVIE_TABLES, Catalog, movie_schema
from millrace.plans.frontend import run_sql
from millrace.plans.plan import run_explain

# column, and the table whose id it refers to
KEYS = {
    "person_id": "name", "movie_id": "title", "linked_movie_id": "title", "person_role_id": "char_name", "role_id": "role_type", "subject_id": "comp_cast_type",
    "status_id": "comp_cast_type", "company_id": "company_name", "company_type_id": "company_type", "info_type_id": "info_type", "keyword_id": "keyword", "link_type_id": "link_type", "kind_id": "kind_type",
}
WORDS = ["top 250 rank", "rating", "production companies", "(co-production)", "(presents) (2006)", "character-name-in-title", "Downey, Robert", "[us]", "USA: 2005", "follows", "it's", "Zé", ""]
COLUMNS = {t: [c.removesuffix(":s") for c in spec.split()] for t, spec in MOVIE_TABLES.items()}
TEXT = {t: [c.removesuffix(":s") for c in spec.split() if c.endswith(":s")] for t, spec in MOVIE_TABLES.items()}
REFERS = {t: [(c, KEYS[c]) for c in cols if c in KEYS] for t, cols in COLUMNS.items()}


def rows_of(table, r):
    n = 14 if REFERS[table] == [] or table == "title" else 32
    for i in range(1, n + 1):
        yield tuple(
            i if c == "id" else (None if r.random() < 0.05 else r.randrange(1, 15)) if c in KEYS
            else r.choice([*WORDS, None]) if c in TEXT[table] else r.choice([None, -1, 0, *range(1990, 2013)]) for c in COLUMNS[table]
        )


@pytest.fixture(scope="module")
def movies(spark):
    r = random.Random(17)
    data = {t: list(rows_of(t, r)) for t in MOVIE_TABLES}
    duck = duckdb.connect()
    for t, rows in data.items():
        duck.execute(f"create table {t} ({', '.join(c + (' varchar' if c in TEXT[t] else ' integer') for c in COLUMNS[t])})")
        duck.executemany(f"insert into {t} values ({', '.join('?' * len(rows[0]))})", rows)
    tables = Catalog({t: spark.createDataFrame(rows, movie_schema(t)).coalesce(1).cache() for t, rows in data.items()})
    return tables, duck


def condition(r, alias, table):
    """A condition on one table; half of them in OR with another."""
    quoted = lambda w: "'" + w.replace("'", "''") + "'"
    if TEXT[table] and r.random() < 0.75:
        c, w = f"{alias}.{r.choice(TEXT[table])}", r.choice(WORDS)
        part = w[1 : 1 + r.randrange(1, 6)].replace("'", "''")
        one = r.choice([
            f"{c} = {quoted(w)}", f"{c} LIKE '%{part}%'", f"{c} NOT LIKE '%{part}_%'", f"{c} IN ({', '.join(map(quoted, r.sample(WORDS, 3)))})", f"{c} IS NULL", f"{c} IS NOT NULL",
            f"{c} > {quoted(w)}", f"{c} BETWEEN 'A' AND 'r'", f"{c} != {quoted(w)}", f"{c} NOT IN ({quoted(w)}, 'x')",
        ])
    else:
        c = f"{alias}.{r.choice([x for x in COLUMNS[table] if x not in TEXT[table]])}"
        one = r.choice([f"{c} > 3", f"{c} BETWEEN 2 AND 2005", f"{c} < 2009", f"{c} IN (1, 2, 3, 2000)", f"{c} >= -1", f"{c} <= 2010", f"{c} != 5", f"{c} IS NOT NULL", f"NOT ({c} = 4)"])
    return f"({one} OR {condition(r, alias, table)})" if r.random() < 0.4 else one


def generated(r, size):
    """A query of ``size`` tables, and its aliases in an order in which each joins one before it."""
    tables, where, same = {"t": "title"}, [], {}
    while len(tables) < size:
        a = r.choice(list(tables))
        ways = [(c, to, "id") for c, to in REFERS[tables[a]]] + [("id", t, c) for t, refers in REFERS.items() for c, to in refers if to == tables[a]]
        if not ways:
            continue
        own, table, other = r.choice(ways)
        b = f"{table[0]}{len(tables)}"
        tables[b] = table
        where.append(f"{a}.{own} = {b}.{other}" if r.random() < 0.5 else f"{b}.{other} = {a}.{own}")
        left, right = same.get((a, own), (a, own)), (b, other)
        same[right] = left
        others = [x for x, to in same.items() if to == left and x[0] not in (a, b)]
        if others and r.random() < 0.5:  # an equality that follows from the others
            x = r.choice(others)
            where.append(f"{x[0]}.{x[1]} = {b}.{other}")
    where += [condition(r, a, t) for a, t in tables.items() if r.random() < 0.3]
    r.shuffle(where)
    outputs = ", ".join(f"MIN({a}.{r.choice(COLUMNS[t])}) AS m{k}" for k, (a, t) in enumerate(r.sample(list(tables.items()), r.randrange(1, 4))))
    return f"SELECT {outputs}\nFROM {', '.join(f'{t} AS {a}' for a, t in tables.items())}\nWHERE {' AND '.join(where)};", list(tables)


def deep(r, aliases):
    """A left-deep EXPLAIN tree that builds either side."""
    scan = lambda a: {"Node Type": r.choice(["Seq Scan", "Index Only Scan"]), "Alias": a}
    tree = scan(aliases[0])
    for a in aliases[1:]:
        sides = [tree, scan(a)]
        k = r.randrange(2)
        sides[k] = {"Node Type": "Hash", "Plans": [sides[k]]}
        tree = {"Node Type": "Hash Join", "Plans": sides}
    return {"Plan": {"Node Type": "Aggregate", "Plans": [tree]}}


@pytest.mark.parametrize("size", [4, *[5] * 6, 6, *[7] * 5, *[8] * 6, *[9] * 4, 10, 10, *[11] * 3, *[12] * 3, 14, 14, 17])
def test_generated_workload_agrees_with_duckdb(movies, size, request):
    tables, duck = movies
    r = random.Random(request.node.name)
    text, aliases = generated(r, size)
    want = [tuple(x) for x in duck.execute(text).fetchall()]
    assert [tuple(x) for x in run_sql(text, tables).collect()] == want, text
    if size < 12:
        assert [tuple(x) for x in run_explain(text, deep(r, aliases), tables).collect()] == want, text
        joined = duck.execute("SELECT COUNT(*) " + text[text.index("\nFROM") :]).fetchall()[0][0]
        assert joined > 10**6 or run_sql(text, tables, pipeline=True).count() == joined


def test_workload_has_rows(movies):
    """The generated queries find something, and use every kind of condition."""
    _, duck = movies
    texts = [generated(random.Random(k), 4 + k % 6)[0] for k in range(60)]
    found = [any(v is not None for v in duck.execute(t).fetchall()[0]) for t in texts]
    assert sum(found) > 40
    for kind in (" LIKE ", "NOT LIKE", " IN (", "NOT IN", "IS NULL", "IS NOT NULL", "BETWEEN", " OR ", "NOT (", " != ", " >= ", " <= "):
        assert any(kind in t for t in texts), kind
