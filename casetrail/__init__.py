"""casetrail: cohort, trajectory, graph and evaluation queries over keyed event logs, as Spark DataFrame jobs."""
