"""tidemark: event-sourced back-testing and research analytics on Spark."""
