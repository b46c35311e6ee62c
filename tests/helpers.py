import datetime as dt


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


def rows(df, *order):
    """Rows as tuples, sorted by the given columns or by all."""
    return sorted((tuple(r) for r in df.collect()), key=lambda r: [(v is None, v) for v in r]) if not order else [
        tuple(r) for r in df.orderBy(*order).collect()
    ]


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
