"""Registered queries, their SQL twins, and the views both run on."""


def _loaded():
    from checks import (  # noqa: F401
        functions,
        ingest,
        passthrough,
        registry,
        relational,
        reports,
        shaping,
    )

    return registry


def all_queries():
    return dict(_loaded().QUERIES)


def all_twins():
    return dict(_loaded().TWINS)
