"""Declarative analysis of genomic sequences and intervals on Spark.

DataFrame operators live in ``operators``, column functions in ``functions``, readers in ``sources``,
the script language in ``plans``. ``strandline.plans.session.Session`` runs scripts.
"""
