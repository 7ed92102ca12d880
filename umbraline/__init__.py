"""umbraline: finding, adjudicating, pseudonymising and verifying personal data as Spark relations."""
