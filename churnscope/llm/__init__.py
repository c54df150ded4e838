"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage.  Each module holds one
operator with its general interface; ``queries.py`` registers one thin query
per operator.  Shared rules, kept by every operator unless its docstring says
otherwise:

* ``text`` NULL is read as the empty text; a NULL ``doc_id`` is a document
  like any other.
* A document is an input row.  Rows that repeat the same id and text are
  copies of each other and get equal results.
* Only the named id and text columns are read, so further columns of any
  name do not clash with internal ones.
* Intermediate tables go to the folder of ``spark.checkpoint.dir``.
"""
