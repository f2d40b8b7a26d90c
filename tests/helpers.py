from datetime import datetime

from shelfmark import schemas


def doc(doc_id, name, owner="o", kind="managed", size=100, added=datetime(2026, 1, 1), opened=None,
        favorite=False, pages=None, collection=None, digest=None, key=None, handle=None):
    digest = digest or f"hash-{name}"
    managed = kind == "managed"
    ref = (kind, f"{digest[:2]}/{digest}.pdf" if managed else None, digest if managed else None,
           None if managed else name, handle)
    return (owner, doc_id, ref, key or digest, digest, name, size, added, opened, favorite, pages, collection)


def library(spark, *rows):
    return spark.createDataFrame(list(rows), schemas.LIBRARY)


def collections(spark, *rows):
    """Rows are (collection_id, name)."""
    return spark.createDataFrame([("o", i, n, datetime(2026, 1, 1)) for i, n in rows], schemas.COLLECTIONS)


def commands(spark, *rows):
    """Rows are (seq, op, doc_id, fields)."""
    out = []
    for seq, op, doc_id, fields in rows:
        out.append(("o", seq, op, doc_id, fields.get("collection"), fields.get("text"), fields.get("flag"),
                    fields.get("ts")))
    return spark.createDataFrame(out, schemas.COMMANDS)


def files(spark, **content):
    rows = [(f"{name}.pdf", datetime(2026, 1, 1), len(data), bytearray(data)) for name, data in content.items()]
    return spark.createDataFrame(rows, schemas.FILES)


def pages(spark, *rows):
    """Rows are (doc_id, page_index, text, rects)."""
    return spark.createDataFrame(
        [(d, p, t, None if r is None else [tuple(map(float, x)) for x in r]) for d, p, t, r in rows],
        schemas.PAGE_TEXT,
    )


def values(df, *columns):
    rows = df.select(*columns).collect()
    return [r[0] if len(columns) == 1 else tuple(r) for r in rows]


def rows_read(df):
    """Rows that the scans of a finished query handed on."""
    def leaves(node):
        children = node.children()
        inner = [node.executedPlan()] if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else (
            [node.plan()] if node.getClass().getSimpleName().endswith("QueryStageExec") else [children.apply(i) for i in range(children.size())])
        return [x for child in inner for x in leaves(child)] or [node]

    return sum(n.metrics().apply("numOutputRows").value() for n in leaves(df._jdf.queryExecution().executedPlan())
               if n.nodeName().startswith("Scan"))
