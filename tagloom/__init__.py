"""Questions of large collections of HTML pages, as Spark plans.

open(spark, path) and append(spark, path) are Corpus.open and CorpusBuilder.onto. Names are imported when first used, so that workers
load no more than their task needs.
"""

from importlib import import_module

_FROM = {
    "Corpus": "operators.corpus", "parse_pages": "operators.corpus", "CorpusBuilder": "operators.builder", "Document": "operators.document", "Element": "operators.document",
    "parse": "operators.document", "Filter": "operators.filter", "Selector": "plans.selector", "SelectorError": "plans.selector",
}
__all__ = [*_FROM, "append", "open"]


def __getattr__(name: str):
    if name == "open":
        return __getattr__("Corpus").open
    if name == "append":
        return __getattr__("CorpusBuilder").onto
    if name not in _FROM:
        raise AttributeError(name)
    return getattr(import_module(f"{__name__}.{_FROM[name]}"), name)
