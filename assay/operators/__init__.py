"""DataFrame operators over a table of evaluation records (see :mod:`assay.schema`)."""
