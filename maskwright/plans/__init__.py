"""Options, pipelines and corpus analytics."""
