"""tidemark: entity resolution, triage and reporting over lookup-tool output, as Spark DataFrame jobs."""
