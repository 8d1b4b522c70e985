"""What whole plans share: tables in the shared folder and checked broadcasts."""
