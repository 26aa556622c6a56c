"""A registry of queries with their oracle statements, one for each module."""

from .views import oracle


class Registry:
    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, name: str, sql: str | None = None):
        def wrap(f):
            self.queries[name] = f
            if sql:
                self.oracles[name] = oracle(sql)
            return f

        return wrap
