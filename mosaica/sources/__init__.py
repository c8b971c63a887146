"""Where units come from."""
