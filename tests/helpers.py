"""Builders of small tables."""

from datetime import datetime

from corpusloom.options import BuildOptions
from corpusloom.sources.tables import CAPTURES, SITE_DOCS, with_site_defaults

PAGE = "<html><head><title>{title}</title></head><body><article>{body}</article></body></html>"


def page(title="T", words=200, links=()):
    anchors = "".join(f'<a href="{h}">l</a> ' for h in links)
    return PAGE.format(title=title, body=f"<h1>{title}</h1><p>{anchors}{'word ' * words}</p>")


def sites(spark, roots, options=BuildOptions(), **columns):
    """``roots`` maps site to root URL; further columns map site to value."""
    names = ["site", "root_url", *columns]
    kinds = {"max_pages": "int", "max_depth": "int", "same_host_only": "boolean", "include": "array<string>", "exclude": "array<string>"}
    schema = ", ".join(["site string", "root_url string", *[f"{c} {kinds[c]}" for c in columns]])
    rows = [tuple([s, root, *[columns[c].get(s) for c in columns]]) for s, root in roots.items()]
    assert len(names) == len(schema.split(", "))
    return with_site_defaults(spark.createDataFrame(rows, schema), options)


def captures(spark, rows):
    """Rows ``(id, site, url, body)`` or with overrides in a trailing dict."""
    full = []
    for row in rows:
        given = row[4] if len(row) > 4 else {}
        full.append(
            (
                row[0],
                row[1],
                row[2],
                given.get("status", 200),
                given.get("content_type", "text/html"),
                row[3],
                given.get("fetched_at", datetime(2024, 1, 1)),
                given.get("channel", "http"),
                given.get("attempt", 1),
            )
        )
    return spark.createDataFrame(full, CAPTURES)


def docs(spark, rows):
    """Dicts with ``site``, ``kind``, ``doc_url`` and ``body``; the rest has defaults."""
    full = [
        (
            r.get("site", "s"),
            r["kind"],
            r.get("doc_url", ""),
            r.get("ord"),
            r.get("page_no"),
            r.get("total_pages"),
            r.get("status", 200),
            r.get("content_type", "application/json" if r["kind"].startswith("rest") else "application/xml"),
            r["body"],
        )
        for r in rows
    ]
    return spark.createDataFrame(full, SITE_DOCS)
