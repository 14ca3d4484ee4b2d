"""Whole queries and the search pipeline assembled from the operators."""


def all_registries():
    from skydrift.plans import data_queries, search_queries, survey_queries

    return [data_queries.R, search_queries.R, survey_queries.R]
