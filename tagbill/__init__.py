"""tagbill: warehouse charge analytics as Spark DataFrame jobs.

Entry points: ``tagbill.plans.billing.Billing`` (the views), ``tagbill.plans.registry``
(the registered queries), ``tagbill.plans.jobs`` (ingest and publish), and
``tagbill.streaming.labor_replies`` (the labor reply stream).
"""

__version__ = "0.1.0"
