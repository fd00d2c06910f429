"""ticketlake: support-conversation analytics as Spark DataFrame operators.

Entry points: `ticketlake.plans.catalog.QUERIES` (registered queries),
`ticketlake.plans.pipeline` (shared lazy plans), `ticketlake.plans.jobs`
(batch jobs) and `ticketlake.streaming.triage` (streaming triage).
"""

__version__ = "0.1.0"
