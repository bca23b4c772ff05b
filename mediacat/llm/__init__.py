"""Operators for preparing large training corpora.

Nothing outside this subpackage (and ``corpus_pipeline.py``) imports it.
Every operator keeps these rules unless its docstring says otherwise:

* a null text is an empty text; a null id is carried like any other value;
* extra columns are ignored, whatever their names, because each operator first
  selects the columns it was told to use;
* empty tables give empty results with the same schema;
* repeated rows are kept, each with its own result row.
"""
