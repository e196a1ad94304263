"""Plans that put operators together: transcripts and reports."""
