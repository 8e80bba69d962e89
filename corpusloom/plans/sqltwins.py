"""SQL fragments that rebuild the benchmark corpus from the raw tables, for checking only."""

from __future__ import annotations

import uuid

from corpusloom.plans.bindings import CORPUS_ID, GRAPHS, NAMESPACE, PREDICATES


def uuid5(namespace: str, name: str) -> str:
    h = f"sha1(unhex('{uuid.UUID(namespace).hex}') || encode({name}))"
    return (f"(substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||"
            f"translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr({h},18,3)||'-'||substr({h},21,12))")


def node_id(pointer: str) -> str:
    return uuid5(NAMESPACE, pointer)


def state_id(event: str) -> str:
    return uuid5(CORPUS_ID, f"('state:'||({event}))")


def _at(day: str, key: str) -> str:
    return f"'{day}T00:00:00.'||lpad(({key})::VARCHAR,9,'0')||'Z'"


def _values(rows: list[tuple], columns: str) -> str:
    body = ", ".join("(" + ", ".join(repr(x) for x in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {body}) t({columns})"


MICROS = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || '000Z'"
FOLD = "strip_accents(lower({}))"
WORDS = r"regexp_extract_all(" + FOLD + r", '[\p{{L}}\p{{N}}]+')"
_START = "length('Placed by ')"

CTES = {
    "decl": _values([(i, *g) for i, g in enumerate(GRAPHS)], "i, graph_key, prefix, decl"),
    "pred": _values([(i, *p) for i, p in enumerate(PREDICATES)], "i, pointer, name"),
    "otext": r"""SELECT *, 'Placed by ['||anchor||']('||target||') in ['||n_name||'](N'||c_nationkey||').' AS prose,
        '[((O'||o_orderkey||'):(PRN002):(C'||o_custkey||')):(PRN001):(N'||c_nationkey||
          CASE WHEN o_orderpriority='1-URGENT' AND o_orderstatus='F' THEN ']' ELSE ')]' END AS notation
      FROM (SELECT o.*, c_name, c_nationkey, n_name, (o_orderpriority='4-NOT SPECIFIED' AND o_orderstatus='F') AS marked,
        CASE WHEN o_orderpriority='5-LOW' THEN 'CX' ELSE 'C' END||o_custkey AS target,
        CASE WHEN o_orderpriority='4-NOT SPECIFIED' AND o_orderstatus='F' THEN c_name||' ⟦pgx:C'||o_custkey||'⟧' ELSE c_name END AS anchor
        FROM orders o JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey)""",
    "node": f"""
      SELECT 'graph' AS kind, graph_key, decl AS pointer, 'object: '||graph_key AS title, 'Namespace '||prefix||'.' AS description,
        {_at('1991-01-01', 'i')} AS created_at, 'promoted' AS lifecycle, 0::BIGINT AS ordinal FROM decl
      UNION ALL SELECT 'predicate','predicates',pointer,'predicate: '||name,'Relation '||name||'.',{_at('1991-01-02', 'i')},'promoted',i+1 FROM pred
      UNION ALL SELECT 'region','regions','RG'||r_regionkey,r_name,'Region '||r_name||'.',{_at('1992-01-01', 'r_regionkey')},'promoted',r_regionkey+1 FROM region
      UNION ALL SELECT 'nation','nations','N'||n_nationkey,n_name,'Nation of ['||r_name||'](RG'||n_regionkey||').',{_at('1992-01-02', 'n_nationkey')},'promoted',n_nationkey+1
        FROM nation JOIN region ON n_regionkey=r_regionkey
      UNION ALL SELECT 'customer',CASE WHEN c_custkey::VARCHAR LIKE '1%' THEN 'customers-one' ELSE 'customers' END,'C'||c_custkey,c_name,
        'Customer in ['||n_name||'](N'||c_nationkey||'). Segment '||c_mktsegment||'.',{_at('1992-01-03', 'c_custkey')},'promoted',c_custkey+1
        FROM customer JOIN nation ON c_nationkey=n_nationkey
      UNION ALL SELECT 'supplier','suppliers','S'||s_suppkey,s_name,'Supplier in ['||n_name||'](N'||s_nationkey||').',{_at('1992-01-04', 's_suppkey')},'promoted',s_suppkey+1
        FROM supplier JOIN nation ON s_nationkey=n_nationkey
      UNION ALL SELECT 'part','parts','P'||p_partkey,p_name,'Supplied as **'||p_name||'** (*S'||p_size||'*), see (*S'||(p_size+60)||
        '*). Kept as written: `(*S0*)` and {{{{{{**x** (*S1*)}}}}}}.',{_at('1992-01-05', 'p_partkey')},'promoted',p_partkey+1 FROM part
      UNION ALL SELECT 'order','orders','O'||o_orderkey,'Order '||o_orderkey,
        prose||chr(10)||chr(10)||'### Traversal expression'||chr(10)||chr(10)||'```pgx-traversal'||chr(10)||notation||chr(10)||'```',
        strftime(o_orderdate,'%Y-%m-%dT%H:%M:%S.')||lpad(o_orderkey::VARCHAR,9,'0')||'Z',
        CASE WHEN o_orderstatus='P' THEN 'staged' ELSE 'promoted' END,o_orderkey+1 FROM otext
      UNION ALL SELECT 'document','documents','D'||doc_id,'Document '||doc_id,text,{_at('1992-01-06', 'doc_id')},'promoted',doc_id+1 FROM documents""",
    # Events as revisions of user nodes.
    "urev": f"""SELECT 'U'||user_id AS pointer, event_id, event_type AS title, 'value='||value||' props='||props AS description, {MICROS} AS created_at,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nth, count(*) OVER (PARTITION BY user_id) AS total,
        first_value(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_event, user_id FROM events""",
    "ident": f"""SELECT pointer, created_at, lifecycle FROM node
      UNION ALL SELECT DISTINCT 'U'||user_id, '1992-01-07T00:00:00.'||lpad(user_id::VARCHAR,9,'0')||'Z', 'promoted' FROM events""",
    "cur": """SELECT pointer, title, description, created_at, lifecycle, kind FROM node
      UNION ALL SELECT pointer, title, description, '1992-01-07T00:00:00.'||lpad(user_id::VARCHAR,9,'0')||'Z', 'promoted', 'user' FROM urev WHERE nth=total""",
    "member": """SELECT graph_key, pointer, ordinal FROM node WHERE lifecycle='promoted'
      UNION ALL SELECT DISTINCT 'users', 'U'||user_id, user_id+1 FROM events""",
    # Every claimed link with the error it has, and where it stands in its text.
    "link": f"""
      SELECT 'N'||n_nationkey AS src, 0 AS idx, 'RG'||n_regionkey AS target, r_name AS anchor, length('Nation of ') AS st,
        length('Nation of ['||r_name||'](RG'||n_regionkey||')') AS en, NULL::VARCHAR AS code, 'promoted' AS lifecycle FROM nation JOIN region ON n_regionkey=r_regionkey
      UNION ALL SELECT 'C'||c_custkey,0,'N'||c_nationkey,n_name,length('Customer in '),length('Customer in ['||n_name||'](N'||c_nationkey||')'),NULL,'promoted'
        FROM customer JOIN nation ON c_nationkey=n_nationkey
      UNION ALL SELECT 'S'||s_suppkey,0,'N'||s_nationkey,n_name,length('Supplier in '),length('Supplier in ['||n_name||'](N'||s_nationkey||')'),NULL,'promoted'
        FROM supplier JOIN nation ON s_nationkey=n_nationkey
      UNION ALL SELECT 'O'||o_orderkey,0,target,anchor,CASE WHEN NOT marked THEN {_START} END,
        CASE WHEN NOT marked THEN length('Placed by ['||anchor||']('||target||')') END,
        CASE WHEN marked THEN 'legacy_visible_pointer_marker' WHEN target LIKE 'CX%' THEN 'unresolved_pointer' END,
        CASE WHEN o_orderstatus='P' THEN 'staged' ELSE 'promoted' END FROM otext
      UNION ALL SELECT 'O'||o_orderkey,1,'N'||c_nationkey,n_name,length('Placed by ['||anchor||']('||target||') in '),length(prose)-1,NULL,
        CASE WHEN o_orderstatus='P' THEN 'staged' ELSE 'promoted' END FROM otext""",
    "occ": """SELECT src, idx, target, anchor, st, en FROM link
      WHERE src NOT IN (SELECT src FROM link WHERE code IS NOT NULL)""",
    "triple": f"""
      SELECT 'N'||n_nationkey AS s, 'PRN001' AS p, 'RG'||n_regionkey AS o, {_at('1993-01-01', 'n_nationkey')} AS created_at FROM nation
      UNION ALL SELECT 'C'||c_custkey,'PRN001','N'||c_nationkey,{_at('1993-01-02', 'c_custkey')} FROM customer
      UNION ALL SELECT 'S'||s_suppkey,'PRN001','N'||s_nationkey,{_at('1993-01-03', 's_suppkey')} FROM supplier
      UNION ALL SELECT 'O'||o_orderkey,'PRN002','C'||o_custkey,{_at('1993-01-04', 'o_orderkey')} FROM orders
      UNION ALL SELECT DISTINCT 'O'||l_orderkey,'PRN003','P'||l_partkey,
        strftime(TIMESTAMP '1994-01-01'+to_seconds(l_orderkey),'%Y-%m-%dT%H:%M:%S.')||lpad(l_partkey::VARCHAR,9,'0')||'Z' FROM lineitem
      UNION ALL SELECT DISTINCT 'P'||l_partkey,'PRN004','S'||l_suppkey,
        strftime(TIMESTAMP '2004-01-01'+to_seconds(l_partkey),'%Y-%m-%dT%H:%M:%S.')||lpad(l_suppkey::VARCHAR,9,'0')||'Z' FROM lineitem""",
    "tag": """SELECT 'D'||doc_id AS pointer, 'D0' AS tag FROM labels WHERE quality=1
      UNION ALL SELECT 'D'||doc_id, 'D1' FROM labels WHERE toxic=1""",
    # Search words of promoted texts with positions; fields lie far apart.
    "tok": f"""SELECT pointer, u.pos + u.base AS pos, u.term FROM (
        SELECT pointer, unnest(list_concat(list_concat(
          list_transform({WORDS.format('pointer')}, lambda x, i: {{'pos': i, 'term': x, 'base': 0}}),
          list_transform({WORDS.format('title')}, lambda x, i: {{'pos': i, 'term': x, 'base': 4294967296}})),
          list_transform({WORDS.format('description')}, lambda x, i: {{'pos': i, 'term': x, 'base': 8589934592}}))) AS u
        FROM cur WHERE lifecycle='promoted')""",
    "dv": """SELECT DISTINCT * FROM (SELECT 'lang:'||lang AS view, 'D'||doc_id AS member FROM documents
      UNION ALL SELECT 'source:'||source, 'D'||doc_id FROM documents
      UNION ALL SELECT 'long', 'D'||doc_id FROM documents WHERE n_chars > 2000
      UNION ALL SELECT 'word:the', 'D'||doc_id FROM documents WHERE contains(text, ' the ')
      UNION ALL SELECT 'quality', 'D'||doc_id FROM labels WHERE quality=1
      UNION ALL SELECT 'toxic', 'D'||doc_id FROM labels WHERE toxic=1)""",
    "turnrow": "SELECT conv_id||'.'||turn AS member, conv_id AS container, turn, role, text FROM conversations",
    "slice": """SELECT 'east' AS label, * FROM orders WHERE o_orderstatus IN ('F','O')
      UNION ALL SELECT 'west', * FROM orders WHERE o_orderstatus IN ('O','P')
      UNION ALL SELECT 'south', * FROM orders WHERE o_orderpriority IN ('1-URGENT','2-HIGH')""",
    "req": """SELECT event_id::VARCHAR AS request_id, event_type, user_id, ts, 1 AS arrival, value, props FROM events
      UNION ALL SELECT event_id::VARCHAR, event_type, user_id, ts, 2, CASE WHEN event_type='error' THEN value+1 ELSE value END, props
        FROM events WHERE event_type IN ('purchase','error')""",
}
_NEEDS = {"node": ("decl", "pred", "otext"), "ident": ("node",), "cur": ("node", "urev"), "member": ("node",), "link": ("otext",), "occ": ("link",), "tok": ("cur",)}


def with_ctes(names: str, body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` behind the named fragments and whatever those build on."""
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, ()):
            add(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        add(name)
    parts = [f"{n} AS ({CTES[n]})" for n in order] + [f"{n} AS ({b})" for n, b in (extra or {}).items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body


def search_ctes(queries: str) -> dict[str, str]:
    """Ranked conjunctive search of ``queries`` (query_id, query) over ``tok``."""
    return {
        "q": queries,
        "u": r"SELECT query_id, i AS unit, regexp_extract_all(" + FOLD.format("list_extract(parts, i)") + r", '[\p{L}\p{N}]+') AS words FROM "
             r"(SELECT query_id, parts, unnest(range(1, len(parts)+1)) AS i FROM (SELECT query_id, regexp_split_to_array(trim(query), '\s+') AS parts FROM q))",
        "uw": "SELECT query_id, unit, len(words) AS n, unnest(range(1, len(words)+1)) AS nth, unnest(words) AS term FROM u",
        "inst": "SELECT query_id, unit, pointer, pos - nth AS start FROM uw JOIN tok USING (term) GROUP BY query_id, unit, n, pointer, pos - nth HAVING count(*) = n",
        "hit": "SELECT query_id, unit, pointer, count(*) AS tf FROM inst GROUP BY ALL",
        "doc": "SELECT pointer, count(*) AS len FROM tok GROUP BY pointer",
        "stat": "SELECT count(*) AS n, avg(len) AS al FROM doc",
        "dfreq": "SELECT query_id, unit, count(*) AS df FROM hit GROUP BY ALL",
        "sc": """SELECT query_id, pointer, count(*) AS matched, round(-sum(greatest(ln((n-df+0.5)/(df+0.5)), 1e-6)*tf*2.2/(tf+1.2*(0.25+0.75*len/al))), 6) AS rank
          FROM hit JOIN dfreq USING (query_id, unit) JOIN doc USING (pointer), stat GROUP BY query_id, pointer""",
        "res": "SELECT query_id, pointer, rank FROM sc JOIN (SELECT query_id, count(*) AS k FROM u GROUP BY 1) USING (query_id) WHERE matched = k",
    }
